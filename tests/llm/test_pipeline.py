"""The pipeline's stages on a small corpus, each against a plain version."""

import re

import corpus_pipeline as P
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    one = P.drop_toxic(spark, docs, SF).cache()
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == COLUMNS and len(toxic & kept) <= 0.3 * len(toxic) and len(every) - len(kept) <= 3 * len(toxic)
    two = P.drop_near_copies(spark, one, SF).cache()
    ids = [r.doc_id for r in two.collect()]
    assert two.columns == COLUMNS and len(ids) == len(set(ids)) and {every[i] for i in kept} == {every[i] for i in ids} | {every[i] for i in kept - set(ids)}
    assert len({every[i] for i in ids}) == len(ids)
    three = P.drop_contaminated(spark, two, SF).cache()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9))}
    clean = {i for i in ids if not any(tuple(w[k : k + 10]) in windows for w in [words(every[i])] for k in range(len(w) - 9))}
    assert {r.doc_id for r in three.collect()} == clean and three.columns == COLUMNS
    four = P.redact_secrets(spark, three, SF).cache()
    assert four.columns == COLUMNS and {r.doc_id for r in four.collect()} == clean
    assert not four.where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count()
    assert all(r.text == every[r.doc_id] or P.REDACTED in r.text for r in four.collect())
    five = P.encode(spark, four, SF)
    assert five.count() == len(clean)


def test_redaction_of_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "a password=deadbeefdeadbeefdeadbeef00 z", "en", "s", 40), (2, None, "en", "s", 0), (None, "token=abcdefghij", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.redact_secrets(spark, docs, SF).collect()}
    assert got[1] == (f"a {P.REDACTED} z", len(f"a {P.REDACTED} z")) and got[2] == (None, 0) and got[None] == (P.REDACTED, len(P.REDACTED))


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_further_columns_with_clashing_names(spark):
    rows = [(1, "password=hunter22 here", "en", "s", 22, 0.5, "x", "y"), (2, None, "en", None, 0, None, None, None), (None, "free text", None, None, 9, 1.0, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, new string")
    for name, stage in P.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "spans", "new"], name
    got = {r.doc_id: (r.text, r.score, r.spans, r.new) for r in docs.collect()}
    assert got == {1: (f"{P.REDACTED} here", 0.5, "x", "y"), 2: (None, None, None, None), None: ("free text", 1.0, "a", "b")}


def test_near_copies_go_row_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    # two texts without an id, one id on two texts, an equal row, a copy without an id, copies without any id, no words
    rows = [(None, text(0)), (None, text(1)), (1, text(2)), (1, text(3)), (1, text(3)), (None, text(3) + " end"), (0, text(2) + " end"), (None, text(4)), (None, text(4)), (5, None), (5, None), (None, ""), (None, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, SF).collect()), key=repr)
    assert got == sorted([rows[0], rows[1], rows[3], rows[6], rows[7], *rows[9:]], key=repr)


def test_contaminated_rows_go_row_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    rows = [(None, f"so {item}"), (None, "clean"), (1, f"and {item}"), (1, "clean too"), (2, None), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.drop_contaminated(spark, docs, SF).collect()), key=repr)
    assert got == sorted([rows[1], *rows[3:]], key=repr)


def test_each_text_of_a_doc_id_has_its_own_secrets_replaced(spark):
    rows = [(1, "a password=hunter22 z"), (1, "longer text, then a password=hunter23 z"), (1, "nothing in here, not even one"), (1, "a password=hunter22 z")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.text for r in P.redact_secrets(spark, docs, SF).collect())
    assert got == sorted([f"a {P.REDACTED} z", f"longer text, then a {P.REDACTED} z", rows[2][1], f"a {P.REDACTED} z"])


def test_stages_on_empty_tables_and_very_long_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    long = " ".join(f"v{k % 997}u{k}" for k in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, f"{long[:500_000]} {item}"), (None, f"{long[800_000:]} password=hunter22 z"), (5, ""), (6, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)
    for _, stage in P.STAGES[1:4]:
        docs = stage(spark, docs, SF).cache()
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {1: long, None: f"{long[800_000:]} {P.REDACTED} z", 5: "", 6: None}
    assert P.encode(spark, docs, SF).count() == 4


def test_secrets_go_from_rows_without_an_id(spark):
    rows = [(None, "password=hunter22 one"), (None, "nothing here"), (None, "x password=hunter23 two"), (4, "nothing here")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.text for r in P.redact_secrets(spark, docs, SF).collect())
    assert got == sorted([f"{P.REDACTED} one", "nothing here", f"x {P.REDACTED} two", "nothing here"])
