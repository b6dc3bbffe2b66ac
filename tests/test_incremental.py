"""Stages on a stream, and vectors for what lacks one: repeats, disorder, restarts, failures."""

import datetime

import numpy as np
import pytest


from quern.operators import embedding as EM
from quern.operators import evaluation as EV
from quern.operators import writes as W
from quern.streaming import stages as ST

EVENT = "document_id long, event_id long, stage string, status string, ts timestamp"


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def rows(df):
    return sorted((r.document_id, r.status, r.stage, r.last_event) for r in df.collect())


def test_stream_ends_as_a_batch_does(spark, tmp_path):
    ok, bad, run = "COMPLETED", "FAILED", "RUNNING"
    history = [
        (1, 1, "click", run), (1, 2, "click", ok), (1, 3, "purchase", ok), (1, 4, "view", ok),
        (2, 5, "click", bad), (2, 6, "click", run), (2, 7, "click", bad), (3, 8, "click", bad), (3, 9, "click", bad), (3, 10, "click", bad),
        (4, 11, "purchase", ok), (5, 12, "view", bad), (5, 13, "view", ok), (6, 14, "other", ok), (7, 15, "click", bad), (7, 16, "click", bad), (7, 17, "click", bad), (7, 18, "click", ok),
    ]
    events = [(*e, at(e[1])) for e in history]
    files = [[events[k] for k in ks] for ks in ([3, 0, 6], [1, 1, 9, 7, 13, 17], [2, 4, 5, 8, 8], [3, 9, 6, 10, 11, 12, 14, 15, 16])]  # out of order, and several twice
    for part in files[:3]:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_on = lambda: ST.run(spark, stream(), f"{tmp_path}/state", lateness="1 day")
    first = rows(run_on())
    assert first == rows(ST.folded(spark.read.parquet(f"{tmp_path}/in")))
    assert rows(run_on()) == first  # restarted, nothing new
    spark.createDataFrame(files[3], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = rows(run_on())
    assert got == rows(ST.folded(spark.createDataFrame(events, EVENT)))
    assert [x[:3] for x in got] == [(1, "READY", None), (2, "RETRYING", "click"), (3, "FAILED", "click"), (4, "PROCESSING", "click"), (5, "PROCESSING", "click"), (6, "PROCESSING", "click"), (7, "PROCESSING", "purchase")]


def test_a_document_without_events_is_stalled(spark, tmp_path):
    def put(*events):
        spark.createDataFrame([(d, n, s, x, at(m)) for d, n, s, x, m in events], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run_on():
        return {r.document_id: r.status for r in ST.run(spark, spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", lateness="1 minute", stall_ms=60_000).collect()}

    put((1, 1, "click", "RUNNING", 0), (2, 2, "click", "FAILED", 0), (2, 3, "click", "FAILED", 0), (2, 4, "click", "FAILED", 0))
    assert run_on()[2] == "FAILED"
    put((3, 5, "click", "RUNNING", 100))
    put((3, 6, "click", "COMPLETED", 101))
    assert run_on() == {1: "STALLED", 2: "FAILED", 3: "PROCESSING"}
    put((1, 7, "click", "COMPLETED", 102), (1, 8, "purchase", "COMPLETED", 102), (1, 9, "view", "COMPLETED", 102))
    assert run_on()[1] == "READY"  # it goes on


def flaky(path, wrong=0):
    """A model of three dimensions that notes its calls and fails the first `wrong` of them."""

    def make():
        def encode(texts):
            import os
            import uuid

            os.makedirs(path, exist_ok=True)
            open(f"{path}/{uuid.uuid4().hex}-{len(texts)}", "w").close()
            if len(os.listdir(path)) <= wrong:
                raise RuntimeError("not now")
            return np.array([[len(t), 1, 0] for t in texts], np.float32)

        return encode

    return make


def test_only_what_lacks_a_vector_is_encoded(spark, tmp_path):
    c = spark.createDataFrame([(1, "one"), (2, "two words"), (3, "one"), (4, "  "), (5, None), (6, "")], "chunk_id long, chunk_text string")
    root, calls = f"{tmp_path}/v", f"{tmp_path}/calls"
    assert EM.encode_missing(root, c.where("chunk_id = 2"), flaky(calls), 3) == 1
    assert EM.encode_missing(root, c, flaky(calls), 3) == 1  # "one", once for two chunks
    before = len(list((tmp_path / "calls").iterdir()))
    assert EM.encode_missing(root, c, flaky(calls), 3) == 0 and len(list((tmp_path / "calls").iterdir())) == before
    got = {r.chunk_id: (r.version, r.embedding and [round(x, 4) for x in r.embedding]) for r in EM.with_vectors(c, root).collect()}
    one = [round(x / 10**0.5, 4) for x in (3, 1, 0)]
    assert got == {1: (2, one), 2: (1, [round(x / 82**0.5, 4) for x in (9, 1, 0)]), 3: (2, one), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_a_batch_that_fails_is_tried_once_more_and_a_failed_run_leaves_nothing(spark, tmp_path):
    c = spark.createDataFrame([(1, "one")], "chunk_id long, chunk_text string").coalesce(1)
    assert EM.encode_missing(f"{tmp_path}/v", c, flaky(f"{tmp_path}/a", 1), 3) == 1
    with pytest.raises(Exception, match="not now"):
        EM.encode_missing(f"{tmp_path}/w", c, flaky(f"{tmp_path}/b", 99), 3)
    assert EM.with_vectors(c, f"{tmp_path}/w").first().embedding is None
    with pytest.raises(Exception, match="dimensions"):
        EM.encode_missing(f"{tmp_path}/w", c, flaky(f"{tmp_path}/c"), 4)
    assert EM.encode_missing(f"{tmp_path}/w", c, flaky(f"{tmp_path}/d"), 3) == 1


def test_updates_can_clear_a_column(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, None), (2, "x"), (9, "y")], "id int, v string")
    read = lambda df: {r.id: r.v for r in df.collect()}
    assert read(W.update(t, new, ["id"])) == {1: "a", 2: "x", 3: "c"} and read(W.update(t, new, ["id"], nulls=True)) == {1: None, 2: "x", 3: "c"}


def test_evaluation_of_hand_made_ranks(spark):
    import math

    ranks = [("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3), ("a", 2, 20, 2), ("b", 1, 12, 1), ("b", 1, 99, 2), ("b", 2, 20, 1), ("b", 2, 21, 11), ("b", 9, 1, 1)]
    gold = [(1, 10), (1, 12), (1, 13), (2, 20), (2, 21), (3, 30), (1, 10)]
    docs = spark.createDataFrame(ranks, "mode string, question_id long, document_id long, rank int")
    got = {r.mode: r for r in EV.report(docs, spark.createDataFrame(gold, "question_id long, document_id long"), ["a", "b", "none"]).collect()}
    g = lambda k: 1 / math.log2(k + 1)
    three, two = g(1) + g(2) + g(3), g(1) + g(2)
    want = {"a": ((2 / 3 + 1 / 2) / 3, ((g(1) + g(3)) / three + g(2) / two) / 3, 1 / 3), "b": ((1 / 3 + 1 / 2) / 3, (g(1) / three + g(1) / two) / 3, 2 / 3), "none": (0, 0, 0)}
    for mode, values in want.items():
        assert (got[mode].n_questions, got[mode].recall, got[mode].ndcg, got[mode].first) == (3, *(round(v, 6) for v in values))
        assert [got[mode].recall_delta, got[mode].ndcg_delta, got[mode].first_delta] == pytest.approx([a - b for a, b in zip(values, want["a"], strict=True)], abs=1e-6)
    passages = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 5, 2), ("a", 1, 4, 3), ("a", 1, 3, 3)], "mode string, question_id long, document_id long, rank int")
    assert sorted((r.document_id, r.rank) for r in EV.by_document(passages).collect()) == [(3, 2), (4, 3), (5, 1)]
