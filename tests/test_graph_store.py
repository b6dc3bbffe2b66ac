"""The stored graph: batches against one build, reprocessed documents, refused moves, contradictions that the expansion won't cross."""

import pytest
from pyspark.sql import functions as F

from quern.operators import kg as K
from quern.operators import kg_store as KS
from quern.queries import kg as G

SF = "/root/testdata/sf0.001"

FIRST = {
    1: ("w1", "Agreement 1", "Vela Corp signed. Expiry date: 2001-06-30"), 2: ("w1", "Agreement 2", "This amends Agreement 1. Expiry date: 2002-06-30. Vela Corp"),
    3: ("w1", "Agreement 3", "It amends agreement 2. Effective date: 2000-01-01. Acme Ltd"), 4: ("w2", "Agreement 1", "Expiry date: 2009-06-30. Vela Corp"),
    5: ("w1", "Letter", "Signed by: Ada Lovelace. Expiry date: 2003-06-30. It amends Agreement 3"),
}


def batch(spark, docs):
    d = spark.createDataFrame([(i, w, t, 10 * i) for i, (w, t, _) in docs.items()], "document_id long, workspace_id string, title string, chunk_id long")
    c = spark.createDataFrame([(10 * i, i, 1, text) for i, (_, _, text) in docs.items()], "chunk_id long, document_id long, page_number int, chunk_text string")
    found = c.select("chunk_id", "document_id", "page_number", F.inline_outer(K.from_text(F.col("chunk_text")))).where("kind is not null")
    titles = c.select("document_id", F.explode(K.amended_titles(F.col("chunk_text"))).alias("title")).join(d.select("document_id", "workspace_id"), "document_id")
    return d, K.with_ids(found.join(d.select("document_id", "workspace_id"), "document_id")), titles


def state(spark, root):
    nodes = {r.node_id: (r.label, r.workspace_id, r.document_id, r.name, r.value) for r in KS.nodes(spark, root).collect()}
    edges = sorted((r.rel_type, r.start_id, r.end_id, r.workspace_id) for r in KS.edges(spark, root).collect())
    return nodes, edges


def said(spark, root):
    nodes, edges = state(spark, root)
    name = lambda n: f"{nodes[n][0]}:{nodes[n][4] or nodes[n][3]}"
    return sorted((r, *sorted((name(a), name(b)))) if r == "CONTRADICTS" else (r, name(a), name(b)) for r, a, b, w in edges if w == "w1")


def merge(spark, root, docs):
    return {r.document_id: r.refused for r in KS.merge(root, *batch(spark, docs)).collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('graph')}/whole"
    merge(spark, root, FIRST)
    return root


def test_batches_in_any_order_make_one_graph(spark, whole, tmp_path):
    want = state(spark, whole)
    assert [x for x in said(spark, whole) if x[0] == "CONTRADICTS"] == [("CONTRADICTS", "DateFact:2001-06-30", "DateFact:2002-06-30"), ("CONTRADICTS", "DateFact:2001-06-30", "DateFact:2003-06-30"), ("CONTRADICTS", "DateFact:2002-06-30", "DateFact:2003-06-30")]
    for k, parts in enumerate([([1, 2], [3, 4, 5]), ([1, 4, 5], [2], [3])]):  # in the second, what links the others comes last
        root = f"{tmp_path}/{k}"
        for part in parts:
            merge(spark, root, {i: FIRST[i] for i in part})
        got = state(spark, root)
        assert got[1] == want[1] and got[0] == want[0]
    merge(spark, root, {2: FIRST[2]})  # again
    assert state(spark, root) == want


def test_a_reprocessed_document_leaves_nothing_of_before(spark, tmp_path):
    root = f"{tmp_path}/g"
    merge(spark, root, FIRST)
    now = {**FIRST, 2: ("w1", "Paper 2", "Expiry date: 2005-06-30. Stone Inc")}
    merge(spark, root, {2: now[2]})
    merge(spark, f"{tmp_path}/fresh", now)
    assert said(spark, root) == said(spark, f"{tmp_path}/fresh")
    values = {n[4] for n in state(spark, root)[0].values() if n[0] == "DateFact" and n[2] == 2}
    assert values == {"2005-06-30"}
    names = {n[3] for n in state(spark, root)[0].values() if n[0] == "Document"}
    assert "Paper 2" in names and "Agreement 2" not in names
    assert not [x for x in said(spark, root) if x[0] == "CONTRADICTS" and "2002" in str(x)]


def test_the_first_writer_of_an_entity_stays_and_moves_are_refused(spark, tmp_path):
    root = f"{tmp_path}/g"
    merge(spark, root, {2: FIRST[2]})
    merge(spark, root, {1: FIRST[1]})
    vela = [n for n in state(spark, root)[0].values() if n[3] == "Vela Corp"]
    assert [n[2] for n in vela] == [2]
    before = state(spark, root)
    assert merge(spark, root, {1: ("w9", "Moved", "Expiry date: 2008-01-01"), 6: ("w9", "New", "Acme Ltd")}) == {1: True, 6: False}
    after = state(spark, root)
    assert before[0].items() <= after[0].items() and {n[3] for n in after[0].values() if n[1] == "w9"} == {"New", "Acme Ltd"}


def test_an_unpublished_version_is_never_read(spark, whole, tmp_path):
    root = f"{tmp_path}/g"
    merge(spark, root, {1: FIRST[1], 4: FIRST[4]})
    before = state(spark, root)
    KS.nodes(spark, root).limit(1).withColumn("version", F.lit(9)).write.mode("append").partitionBy("version", "workspace_id").parquet(f"{root}/nodes")
    assert state(spark, root) == before and KS.next_version(spark, root) == 10
    merge(spark, root, {2: FIRST[2], 3: FIRST[3], 5: FIRST[5]})
    assert state(spark, root) == state(spark, whole)
    assert {(r.workspace_id, r.version) for r in KS.published(spark, root).collect()} == {("w1", 10), ("w2", 1)}  # w2 wasn't written again


def test_the_expansion_meets_a_contradiction_and_refuses_it(spark, whole):
    nodes, edges = KS.nodes(spark, whole), KS.edges(spark, whole)
    fact = nodes.where("value = '2001-06-30'").select("node_id").first()[0]
    seeds = spark.createDataFrame([(1, "w1", fact)], "question_id long, workspace_id string, node_id string")
    scope = spark.createDataFrame([(1, i) for i in (1, 2, 3, 5)], "question_id long, document_id long")
    assert edges.where(f"rel_type = 'CONTRADICTS' AND '{fact}' IN (start_id, end_id)").count() == 2
    met = K.expand(seeds, edges, nodes, scope, hops=1)
    assert {r.rel_type for r in met.collect()} == {"EXPIRES_ON"}


def test_comparisons_meet_all_of_their_workspace(spark):
    """Only packages compare six chosen documents."""
    there = G.live(spark, SF).where("workspace_id = 'w1' AND processing_status = 'READY'").count()
    assert G.graph_scope(spark, SF).where("question_id = 1").count() == there > 6
    assert G.graph_scope(spark, SF, chosen=True).where("question_id = 1").count() == 6


def test_expansion_builds_no_contradictions(spark, monkeypatch):
    made = []
    monkeypatch.setattr(G, "stored", lambda s, d, name, make, *by: made.append(name) or make(s, d))
    G._met(spark, SF)
    assert "met" in made and "contradicts" not in made
