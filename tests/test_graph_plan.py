"""The graph's plan: what a text gives, nodes and edges by their keys, and what a question meets of them."""

import glob
import random

from pyspark.sql import functions as F

from quern import queries as own
from quern.operators import kg as K
from quern.queries import kg as G


def test_a_text_gives_the_titles_that_it_amends(spark):
    texts = [("This AMENDS Document 7. It amends Document 7 and Vela Corp signed",), ("nothing",), (None,)]
    got = spark.createDataFrame(texts, "t string").select(F.inline_outer(K.from_text(F.col("t")))).where("kind = 'Document'").collect()
    assert [(r.name, r.rel_type) for r in got] == [("Document 7. It amends Document 7 and Vela Corp signed", "AMENDS")]
    got = spark.createDataFrame([("amends Paper 1.\nlater amends Paper 1\nand amends Paper 2",)], "t string").select(F.inline(K.from_text(F.col("t")))).collect()
    assert [(r.kind, r.name, r.rel_type) for r in got] == [("Document", "Paper 1", "AMENDS"), ("Document", "Paper 2", "AMENDS")]


def graph(spark):
    r = random.Random(5)
    docs = {d: f"w{d % 2 + 1}" for d in range(30)}
    rows = [(10 * d + k, d, k, w, *r.choice([("Organization", "MENTIONS"), ("Organization", "SIGNED"), ("Person", "MENTIONS")]), r.choice(["Vela  Corp", "vela corp", "Acme Ltd", "Ada L", "Bo M", "Cy N", "Di O"])) for d, w in docs.items() for k in range(2)]
    names = spark.createDataFrame(rows, "chunk_id long, document_id long, page_number int, workspace_id string, kind string, rel_type string, name string").withColumns({c: F.lit("") for c in ("fact_label", "value", "currency")})
    rows = [(10 * d + k, d, k, w, "Amount", v, "HAS_VALUE", "price", v, c) for d, w in docs.items() for k, v, c in ((0, str(r.randrange(3)), "USD"), (1, str(r.randrange(3)), r.choice(["", "USD"])))]
    rows += [(10 * d + k, d, k, w, "DateFact", "2001-01-01", "EXPIRES_ON", "expiry date", "2001-01-01", "") for d, w in docs.items() for k in (1, 0)]
    facts = spark.createDataFrame(rows, "chunk_id long, document_id long, page_number int, workspace_id string, kind string, name string, rel_type string, fact_label string, value string, currency string")
    links = [(a, b) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(25)) if a != b and docs[a] == docs[b]]
    return docs, names, facts, spark.createDataFrame(sorted(set(links)), "a long, b long")


def test_nodes_and_edges_by_the_parts_of_their_keys(spark):
    """Their ids were written and shuffled with them, twice for each edge."""
    docs, names, facts, _ = graph(spark)
    every = K.with_ids(names.unionByName(facts))
    said, own = K.mentions(names), K.fact_nodes(facts)
    cols = ["node_id", "label", "workspace_id", "document_id", "name", "normalized_name", "fact_label", "value", "currency", "source_chunk_id", "source_page"]
    assert sorted(K.nodes_of(own, K.named_nodes(said)).select(cols).collect(), key=str) == sorted(K.entity_nodes(every).select(cols).collect(), key=str)
    got = sorted(map(tuple, K.edges_of(own, said).select("rel_type", "start_id", "end_id").collect()))
    assert got == sorted(map(tuple, K.entity_edges(every).collect())) and len(got) > 100


def test_what_a_question_meets_equals_the_expansion(spark):
    docs, names, facts, amended = graph(spark)
    said, own = K.mentions(names), K.fact_nodes(facts)
    nodes = K.nodes_of(own, K.named_nodes(said)).select("node_id", "label", "workspace_id", "document_id").unionByName(spark.createDataFrame([(d, w) for d, w in docs.items()], "document_id long, workspace_id string").select(K.document_node(F.col("document_id")).alias("node_id"), F.lit("Document").alias("label"), "workspace_id", "document_id"))
    edges = K.edges_of(own, said).select("rel_type", "start_id", "end_id").unionByName(K.edges_of_amended(amended))
    scope = spark.createDataFrame([(q, w, d, f"t{d}", 10 * d) for q, w in ((1, "w1"), (2, "w2"), (3, "w1")) for d, x in docs.items() if x == w and (d + q) % 5], "question_id long, workspace_id string, document_id long, title string, first_chunk long")
    first = spark.createDataFrame([(1, 4), (1, 8), (2, 5), (2, 1)], "question_id long, document_id long").join(scope.select("question_id", "document_id"), ["question_id", "document_id"], "left_semi")
    named = spark.createDataFrame([(2, "w2", "Organization", "acme ltd"), (3, "w1", "Person", "ada l"), (3, "w1", "Organization", "vela corp")], "question_id long, workspace_id string, kind string, key string")
    ids = named.withColumns({"name": F.col("key"), "document_id": F.lit(0), **{c: F.lit("") for c in ("fact_label", "value", "currency")}}).select("question_id", "workspace_id", F.sha2(K.key_of(), 256).alias("node_id"))
    seeds = ids.unionByName(first.join(scope.select("question_id", "workspace_id").distinct(), "question_id").select("question_id", "workspace_id", K.document_node(F.col("document_id")).alias("node_id")))
    both = amended.toDF("x", "y").unionByName(amended.select(F.col("b").alias("x"), F.col("a").alias("y")))
    for hops in (1, 2, 3):
        want = {tuple(r) for r in K.expand(seeds, edges, nodes, scope, hops).collect()}
        of_facts, of_names, of_amends = K.met(K.reach(first, named, said, both, scope, hops), own, said, amended, scope)
        got = [tuple(r) for part in (K.edges_of(of_facts, of_names, "question_id"), K.edges_of_amended(of_amends, "question_id")) for r in part.select("question_id", "rel_type", "start_id", "end_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_the_graph_is_kept_without_ids(spark, monkeypatch):
    """Candidates, nodes and edges were kept with two or three hashes of 64 characters in each row: nearly all of the disk that was taken."""
    kept = {}

    def keep(s, d, name, make, *by):
        kept[name] = make(s, d)
        return kept[name]

    monkeypatch.setattr(G, "stored", keep)
    for name in ("kg_write_entity", "merge_relationship", "bounded_bfs"):
        own.queries()[name](spark, "/root/testdata/sf0.001")
    assert "facts" in kept and not {c for df in kept.values() for c in df.columns} & {"node_id", "doc_node", "start_id", "end_id"}


def test_values_that_contradict(spark):
    r = random.Random(6)
    links = spark.createDataFrame([(0, k) for k in range(1, 8)] + [(20, 21)], "start_id long, end_id long")
    rows = [(d, "w1", r.choice(["DateFact", "Amount"]), r.choice(["price", "fee"]), str(r.randrange(4)), "", 1) for d in [*range(9), 20, 21] for _ in range(5)]
    facts = spark.createDataFrame(sorted(set(rows)), "document_id long, workspace_id string, label string, fact_label string, value string, currency string, q int")
    seeds = spark.createDataFrame([(d,) for d in (1, 2, 3, 8, 20, 21)], "document_id long")
    mine = facts.join(seeds, "document_id")
    want = {(p.label, p.fact_label, *sorted((p.left_value, p.right_value))) for p in K.fact_pairs(seeds, links, mine, ["q"]).collect() if "2" in (p.left_value, p.right_value)}
    got = K.value_pairs(seeds, links, mine.withColumn("asked", F.col("value") == "2"), ["q"]).collect()
    assert {(p.label, p.fact_label, *sorted((p.left_value, p.right_value))) for p in got} == want and len(want) > 3 and {p.left_value for p in got} == {"2"}


def test_facts_are_copied_for_large_groups_alone(spark, monkeypatch):
    """Each was copied sixteen times, whatever the size of its group."""
    monkeypatch.setattr(K, "PART", 3)
    links = spark.createDataFrame([(0, k) for k in range(1, 20)] + [(50, 51)], "start_id long, end_id long")
    facts = spark.createDataFrame([(d, "w1", "Amount", "price", str(d % 7), "USD") for d in [*range(20), 50, 51, 60]], "document_id long, workspace_id string, label string, fact_label string, value string, currency string")
    got = K.fact_pairs(facts.select("document_id"), links, facts, [])
    assert got.count() == sum(a % 7 != b % 7 for a in range(20) for b in range(a)) + 1
    assert {tuple(r) for r in got.select("left_node", "right_node").collect()} == {tuple(sorted(r)) for r in got.select("left_node", "right_node").collect()}


def test_pages_of_long_lists_are_looked_at_often(spark):
    """The writer guessed from the empty lists of other requests, and held up to 10,000 long ones in one page."""
    own.queries()["scope_resolve_module"](spark, "/root/testdata/sf0.001")
    seen = spark._jsparkSession.sessionState().newHadoopConf()
    assert [seen.get(f"parquet.{part}.size.row.check.max") for part in ("page", "block")] == ["16", "16"]


def test_around_equals_related(spark):
    """What a batch reaches was found as pairs with each of its documents."""
    r = random.Random(7)
    links = spark.createDataFrame([(r.randrange(30), r.randrange(30)) for _ in range(20)], "start_id long, end_id long")
    seeds = spark.createDataFrame([(1,), (5,), (5,), (99,)], "node_id long")
    for hops in (1, 3):
        got = [x.node_id for x in K.around(seeds, links, hops).collect()]
        assert len(got) == len(set(got)) and set(got) == {x.node_id for x in K.related(seeds, links, hops).collect()}


def test_vectors_are_kept_small(spark, tmp_path):
    from quern.operators import embedding as EM
    from quern.queries.records import hashed_bags

    chunks = spark.createDataFrame([("one two",), ("three",), ("one two",), (" ",)], "chunk_text string")
    assert [EM.encode_missing(f"{tmp_path}/v", chunks, hashed_bags, 64) for _ in range(2)] == [2, 0]
    files = glob.glob(f"{tmp_path}/v/vectors/**/*.parquet", recursive=True)
    assert files and all(f.endswith(".zstd.parquet") for f in files)
