"""Every query against its SQL on the smallest tables; and rules that SQL doesn't show."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import queries as own
from quern.functions import similarity as S
from quern.functions import text as T
from quern.functions import websearch
from quern.operators import fusion, graph, layout
from quern.sources import files
from quern.streaming import jobs

SF = "/root/testdata/sf0.001"
SQL = own.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = own.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert rows(df.select(cols).collect()) == rows([r[i] for i in at] for r in got.fetchall())


def test_pack_is_greedy(spark):
    chunks = spark.createDataFrame([(1, k, f"s{k}", n) for k, n in enumerate([3, 4, 9, 1, 5])] + [(2, 0, "x", 20)], "document_id long, pos int, chunk_text string, token_count long")
    got = layout.packed(chunks, 8).orderBy("document_id", "chunk").collect()
    assert [(r.document_id, r.text, r.token_count) for r in got] == [(1, "s0 s1", 7), (1, "s2", 9), (1, "s3 s4", 6), (2, "x", 20)]


def test_pieces_join_to_the_text(spark):
    text = "word " * 90 + "x" * 450
    got = spark.createDataFrame([(text,)], "t string").select(T.pieces(F.col("t")).alias("p")).first().p
    assert "".join(got) == text and all(0 < len(p) <= 200 for p in got)


def test_cosine_of_zero_and_uneven_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 0.0], [5.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(S.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]


def test_rrf_counts_the_best_rank_of_each_channel(spark):
    df = spark.createDataFrame([(1, "vector", 1), (1, "vector", 3), (1, "keyword", 2), (2, "keyword", 1)], "id int, channel string, rank int")
    got = {r.id: (round(r.rrf_score, 9), r.provenance) for r in fusion.rrf(df, ["id"]).collect()}
    assert got == {1: (round(1 / 61 + 1 / 62, 9), "vector,keyword"), 2: (round(1 / 61, 9), "keyword")}


def test_quota_caps_and_lifts(spark):
    two = spark.createDataFrame([(d, 10 * d + k, float(-k)) for d in (1, 2) for k in range(6)], "document_id int, id int, score double")
    assert fusion.quota(two, "id", 5, 0.4).groupBy("document_id").count().agg(F.max("count")).first()[0] <= 2
    assert fusion.quota(two.where("document_id = 1"), "id", 5, 0.4).count() == 5


def test_bfs_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert {(r.start, r.node, r.hops) for r in graph.reachable(edges, 5).where("start = 1").collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 1)}


def test_exports_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, "c")], "id long, v string")
    files.export_csv(df, f"{tmp_path}/csv")
    files.export_json(df, f"{tmp_path}/json")
    assert rows(spark.read.csv(f"{tmp_path}/csv", header=True, escape='"', schema="id long, v string").collect()) == rows(df.collect())
    assert rows(spark.read.schema("id long, v string").json(f"{tmp_path}/json").collect()) == rows(df.collect())


def test_uploads_are_split(spark, tmp_path):
    for name, size in (("a.pdf", 3), ("b.txt", 3), ("c.docx", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    good, bad = files.uploads(spark, f"{tmp_path}")
    assert [os.path.basename(r.path) for r in good.collect()] == ["a.pdf"]
    assert {(os.path.basename(r.path), r.reject_code) for r in bad.collect()} == {("b.txt", "EXTENSION")}  # Spark lists no empty files


def test_windowed_counts(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert jobs.windowed(events).agg(F.sum("n")).first()[0] == events.count()


def test_websearch_grammar():
    assert websearch.parse('"a b" c OR -d e') == [[("a", "b"), ("c",)], [("e",)]]
    assert websearch.parse('"odd quote') == [[("odd",), ("quote",)]] and websearch.parse("-x OR") == []
    assert websearch.parse('x-1 "" or "B c"') == [[("x",), ("1",)], [("b", "c")]]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8


def test_answer_replay_has_the_whole_text(spark, tmp_path):
    long = "word " * 90 + "x" * 450
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", "short"), (2, 1, "assistant", " \n"), (2, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in own.queries()["answer_replay"](spark, str(tmp_path)).orderBy("conv_id", "turn", "ordinal").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.ordinal, r.type, r.payload))
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    for (_, _, _, text), events in zip(rows[1:], got.values(), strict=True):
        *tokens, citation, done = events
        assert "".join(p for _, _, p in tokens) == (text if (text or "").strip() else "")
        assert all(t == "token" and 0 < len(p) <= 200 for _, t, p in tokens) and [o for o, _, _ in events] == list(range(len(events)))
        assert citation[1:] == ("citation", "assistant") and done[1:] == ("done", "")
    assert len(got[1, 1]) > 4 and len(got[2, 1]) == len(got[2, 2]) == 2


def test_sections_of_deep_levels(spark):
    number = lambda n: ".".join(["1"] * n)
    levels = [12, 13, 14, 13, 12, 1, 15]
    lines = spark.createDataFrame([(d, 40 * k, k + 1, f"{number(n)} Title") for d in (1, 2) for k, n in enumerate(levels)], "document_id long, pos int, page_number int, line string")
    for d in (1, 2):
        got = [(r.level, r.parent_pos, r.end_page) for r in layout.sections(lines).where(F.col("document_id") == d).orderBy("pos").collect()]
        assert got == [(12, None, 5), (13, 0, 4), (14, 40, 4), (13, 0, 5), (12, None, 6), (1, None, 7), (15, 200, 7)]
