"""Operators on small fixtures of their own: scopes, writes, balance, expansion, claims, chunks, rules."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import text as T
from quern.functions import websearch
from quern.operators import chunking, claims, fusion, kg, scope, textindex, writes
from quern.plans import evidence
from quern.sources import files, stored
from quern.sources import views as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_scopes(spark):
    docs = spark.createDataFrame([(1, "w1", "a", "READY", False), (2, "w1", "b", "INDEXING", False), (3, "w1", "a", "READY", True), (4, "w2", "a", "READY", False), (5, "w3", "c", "INDEXING", False)], "document_id long, workspace_id string, group_id string, processing_status string, deleted boolean")
    asked = [("q1", "w1", "WORKSPACE", None, None), ("q2", "w1", "MODULE", "b", None), ("q3", "w1", "MODULE", "zz", None), ("q4", "w1", "DOCUMENTS", None, [1, 2, 1]), ("q5", "w1", "DOCUMENTS", None, [1, 4]), ("q6", "w1", "DOCUMENTS", None, [3]), ("q7", "w3", "WORKSPACE", None, None), ("q8", "none", "WORKSPACE", None, None), ("q9", "w1", "MODULE", "a", None)]
    req = spark.createDataFrame(asked, "request_id string, workspace_id string, scope_type string, group_id string, ids array<long>")
    got = {r.request_id: (r.code, r.document_ids) for r in scope.resolve(req, docs).collect()}
    outside = ("SCOPE_OUTSIDE_WORKSPACE", [])
    assert got == {"q1": ("OK", [1]), "q2": ("EMPTY_SCOPE", []), "q3": ("MODULE_NOT_FOUND", []), "q4": ("OK", [1]), "q5": outside, "q6": outside, "q7": ("EMPTY_SCOPE", []), "q8": ("EMPTY_SCOPE", []), "q9": ("OK", [1])}
    wanted = spark.createDataFrame([("q", "w1", i) for i in (1, 2, 3, 4, 9)], "request_id string, workspace_id string, document_id long")
    assert {r.document_id: r.verdict for r in scope.guard(wanted, docs).collect()} == {1: "READY", 2: "EXCLUDED", 3: "SCOPE_VIOLATION", 4: "SCOPE_VIOLATION", 9: "SCOPE_VIOLATION"}


def test_keyed_writes(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "z")], "k int, v string, w string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(writes.update(t, new, ["k"])) == [(1, "a", "x"), (2, "b", "n")]
    assert rows(writes.insert_missing(t, new, ["k"])) == rows(t.unionByName(new.where("k = 3")))
    assert rows(writes.delete(t, new.select("k"))) == [(1, "a", "x")]
    assert rows(writes.replace(t, new, ["k"])) == [(1, "a", "x"), *rows(new)]
    jobs = spark.createDataFrame([(1, 5, 10), (1, None, 12), (1, 7, 3), (2, None, 1), (2, None, 4)], "d int, at int, job int")
    assert rows(writes.latest(jobs, ["d"], [F.col("at"), F.col("job")]).select("d", "job")) == [(1, 3), (2, 4)]


def test_balance_against_turns(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [(1, kind, 100 * d + k, d, None if rng.random() < 0.3 else f"s{rng.randrange(3)}", rng.randrange(4) / 4) for kind in [rng.choice(["comparison", "summary", "fact"])] for d in range(rng.randrange(1, 4)) for k in range(rng.randrange(1, 9))]
        got = [r.chunk_id for r in evidence.balanced(spark.createDataFrame(rows, "question_id int, kind string, chunk_id int, document_id int, section string, score double")).orderBy("place").collect()]
        order = sorted(rows, key=lambda r: (-r[5], r[2]))
        if rows[0][1] == "fact":
            want = [r[2] for r in order[:8]]
        elif rows[0][1] == "summary":
            seen, first, late = set(), [], []
            for r in order:
                (late if r[4] in seen else first).append(r[2])
                seen |= {r[4]} - {None}
            want = (first + late)[:12]
        else:
            left = {d: [r[2] for r in order if r[3] == d] for d in sorted({r[3] for r in rows})}
            beyond, want, used = len([d for d in left if len(left[d]) > evidence.CAP]), [], dict.fromkeys(left, 0)
            for turn in range(20):
                for d in left:
                    if turn < len(left[d]) and len(want) < 8 and (turn < evidence.CAP or len(left) == 1 or beyond == 1):
                        want.append(left[d][turn])
                        used[d] += 1
        assert got == want, rows


def test_diverse_equals_the_whole_order(spark):
    rng = random.Random(6)
    for n in (3, 40, 200):
        rows = [(k, rng.choice([None, *range(n // 4 + 1)]), rng.randrange(9) / 9) for k in range(n)]
        got = [r.id for r in fusion.diverse(spark.createDataFrame(rows, "id int, sec int, score double"), "sec", "id", 12).collect()]
        seen, first, late = set(), [], []
        for k, sec, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
            (late if sec in seen else first).append(k)
            seen |= {sec} - {None}
        assert got == (first + late)[:12]


def test_what_lies_inside(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    short = [(i, rng.choice("xy"), word(rng.randrange(0, 6))) for i in range(60)]
    long = [(i, rng.choice("xy"), word(rng.randrange(0, 15))) for i in range(60)]
    got = sorted(map(tuple, kg.inside(spark.createDataFrame(short, "short_id long, ws string, text string"), spark.createDataFrame(long, "long_id long, ws string, text string"), "ws").collect()))
    assert got == sorted((i, j) for i, w, a in short for j, v, b in long if w == v and a and a in b)


def test_graph_stays_in_scope(spark):
    node = lambda i, label, ws, doc, name: (i, label, ws, doc, name, name if label == "Organization" else None, None, "v" if label == "DateFact" else None, None, doc and doc * 10, 1)
    nodes = spark.createDataFrame([node("A", "Document", "w1", 1, "a"), node("B", "Document", "w1", 2, "b"), node("D", "Document", "w1", 3, "d"), node("G", "Document", "w2", 4, "g"), node("o", "Organization", "w1", 1, "acme"), node("p", "Organization", "w2", 4, "acme"), node("f", "DateFact", "w1", 1, "x"), node("l", "DateFact", "w1", 3, "y")], "node_id string, label string, workspace_id string, document_id long, name string, normalized_name string, fact_label string, value string, currency string, source_chunk_id long, source_page int")
    edges = spark.createDataFrame([("SIGNED", "o", "A"), ("SIGNED", "o", "D"), ("SIGNED", "p", "G"), ("EXPIRES_ON", "A", "f"), ("EXPIRES_ON", "D", "l"), ("AMENDS", "B", "A"), ("CONTRADICTS", "f", "l"), ("AMENDS", "A", "D")], "rel_type string, start_id string, end_id string")
    seeds = spark.createDataFrame([(1, "w1", "o")], "question_id int, workspace_id string, node_id string")
    scope_ = spark.createDataFrame([(1, 1), (1, 2)], "question_id int, document_id long")
    met = kg.expand(seeds, edges, nodes, scope_)
    # D isn't in scope and is no bridge; nothing of w2; no contradiction
    assert {(r.rel_type, r.start_id, r.end_id) for r in met.collect()} == {("SIGNED", "o", "A"), ("EXPIRES_ON", "A", "f"), ("AMENDS", "B", "A")}
    facts = {(r.relationship, r.subject, r.object, r.document_id) for r in kg.facts_of(met, nodes, scope_).collect()}
    assert facts == {("SIGNED", "acme", "a", 1), ("EXPIRES_ON", "a", "v", 1), ("AMENDS", "b", "a", 2)}


def test_contradictions_need_the_asking_document(spark):
    f = spark.createDataFrame([("A", "1", "DateFact", "expiry date", "2001", 1), ("B", "2", "DateFact", "expiry date", "2002", 2), ("C", "3", "DateFact", "expiry date", "2003", 3), ("A", "4", "Amount", "fee", "5", 1)], "doc_node string, node_id string, label string, fact_label string, value string, document_id long")
    near = spark.createDataFrame([("A", "A"), ("A", "B"), ("A", "C")], "origin string, node_id string")
    assert {(r.left_node, r.right_node, r.left_value, r.right_value) for r in kg.contradictions(near, f).collect()} == {("1", "2", "2001", "2002"), ("1", "3", "2001", "2003")}
    amends = spark.createDataFrame([("AMENDS", str(i), str(i + 1)) for i in range(8)], "rel_type string, start_id string, end_id string")
    assert {r.node_id for r in kg.related(spark.createDataFrame([("7",)], "node_id string"), amends).collect()} == {str(i) for i in range(2, 9)}


def test_claims(spark):
    draft = "The term ends in 2001. [chunk:7] It is [chunk:99] long. Vela keeps keys"
    got = one(spark, claims.draft_claims(F.col("t")), t=draft)
    assert [(c.claim, c.cited) for c in got] == [("The term ends in 2001 .", 7), ("It is long.", 99), ("Vela keeps keys", None)]
    assert one(spark, claims.draft_claims(F.col("t")), t="No supporting evidence found.") is None and one(spark, claims.draft_claims(F.col("t")), t=" ") is None
    c = spark.createDataFrame([(1, 0, "term ends 2001", 7), (1, 1, "keys kept", 99), (1, 2, "purple mountains", None), (2, 0, "keys kept", 8)], "question_id int, pos int, claim string, cited long")
    e = spark.createDataFrame([(1, 7, 1, "The term ends in 2001."), (1, 8, 2, "The keys are kept here"), (2, 8, 1, "nothing like it")], "question_id int, chunk_id long, place int, text string")
    bad = spark.createDataFrame([(1, "term", "2001", "2002")], "question_id int, label string, left_value string, right_value string")
    v = {(r.question_id, r.pos): (r.cited, r.supported_by_text, r.supported_by_graph, r.is_supported) for r in claims.verify(c, e, bad).collect()}
    assert v == {(1, 0): (7, True, False, False), (1, 1): (8, True, True, True), (1, 2): (None, False, True, False), (2, 0): (8, False, True, False)}
    top = spark.createDataFrame([(1, 0.5)], "question_id int, top double")
    a = {r.question_id: (r.answer, r.n_supported, round(r.confidence, 6), r.is_not_found) for r in claims.answers(claims.verify(c, e, bad), top).collect()}
    assert a == {1: ("keys kept", 1, round(0.7 / 3 + 0.15, 6), False), 2: ("", 0, 0.0, True)}


def test_chunks_of_sections(spark):
    pages = spark.createDataFrame([(1, 1, "Intro\n\nfirst words here.\n\nTerms\n\nterm words."), (1, 2, "more of terms.\n\nAnnex\n\nannex words.")], "document_id long, page_number int, raw_text string")
    sections = spark.createDataFrame([(1, 1, None, "Intro", 1, 1), (1, 2, None, "Terms", 1, 2), (1, 3, None, "Annex", 2, 2)], "document_id long, section_id long, parent_id long, heading string, start_page int, end_page int")
    got = sorted((r.section_id, r.page_number, r.paragraph) for r in chunking.paragraphs(sections, pages).collect())
    assert got == [(1, 1, "first words here."), (2, 1, "term words."), (2, 2, "more of terms."), (3, 2, "annex words.")]
    packed = sorted((r.section_id, r.chunk, r.page_number, r.chunk_text) for r in chunking.chunks(chunking.paragraphs(sections, pages), 5).collect())
    assert packed == [(1, 0, 1, "first words here."), (2, 0, 1, "term words."), (2, 1, 2, "more of terms."), (3, 0, 2, "annex words.")]
    assert one(spark, chunking.pieces(F.col("t"), 6), t="One two. Three four five. Six seven eight nine ten eleven twelve. End.") == ["One two.", "Three four five.", "Six seven eight nine ten eleven twelve.", "End."]


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (R.notice_period, "with 30 days written notice", "30 days"), (R.notice_period, "1 day notice", "1 day"), (R.notice_period, "30 days", None),
        (R.parties, "Parties: A Corp and B", "A Corp and B"), (R.parties, "x Acme Corp y Oak Street Ltd. z Acme Corp", "Acme Corp, Oak Street Ltd"), (R.parties, "none", None),
        (R.effective_date, "on 2001-01-01, Effective Date: 2002-02-02", "2002-02-02"), (R.effective_date, "on 2001-01-01", "2001-01-01"),
        (R.reference, "Agreement no. AB-1234", "AB-1234"), (R.reference, "ref 12", None), (R.topics_line, "Topics: a, b\nc", "a, b"),
        (R.amounts, "Total fee: $1,200.50, Base: $7", ["Total fee: $1,200.50", "Base: $7"]), (R.split_names, "A, B and C.", ["A", "B", "C"]),
        (R.date_label, "Expiration date", "expiry date"), (R.date_label, "Signed", "signed"), (R.keyword_style, "What is the X-12 of you", "X-12"),
        (R.is_phone_line, "+49 (30) 123-456", True), (R.is_phone_line, "12345", False), (R.is_noise_slide, "Slide 12", True), (R.is_noise_slide, "Plan", False),
        (R.is_sentence_slide, "It will be so for all of us here", True), (R.is_sentence_page, "The plan", True), (R.is_ocr_title, "Plan for 2020", True), (R.is_ocr_title, "x@y.z", False),
        (T.count_tokens, " \n", 0), (T.count_tokens, "Héllo, you", 3), (R.uuid_or_none, "nope", None), (R.safe_message, "OCR", R.MESSAGES["OCR"]), (files.module_of, "../x/y", None), (files.module_of, "\\a\\b.pdf", "a"),
        (R.question_kind, "Compare them", "comparison"), (R.question_kind, "who?", "fact"), (T.is_identifier_like, "AB-12 c", True), (R.is_pure_identifier, "AB-12 c", False),
    ],
)
def test_rules(spark, column, text, want):
    assert one(spark, column(F.col("t")), t=text) == want


def test_amounts_and_labels(spark):
    p = one(spark, R.parse_amount(F.col("t")), t="fee: $1,200.50 EUR")
    assert (p.number, p.currency) == ("1200.50", "USD")
    assert one(spark, R.amount_label(F.col("n"), F.col("v")), n="Amounts", v="Late fee: $3") == "late fee"
    assert one(spark, R.amount_label(F.col("n"), F.col("v")), n="Price", v="3: $3") == "price"


def test_vectors_as_text(spark):
    df = spark.createDataFrame([([0.5, -1.0],), ([],)], "v array<double>").select(V.vector_text(F.col("v")).alias("t"))
    assert [r.t for r in df.collect()] == ["[0.50000000,-1.00000000]", "[]"]
    assert [r.v for r in df.select(V.vector_of("t").alias("v")).collect()] == [[0.5, -1.0], []]


def test_searches_as_a_relation(spark):
    queries = ['"a b" c OR -d e', '"odd quote', "-x OR", "a a", "OR or b", '"b" "c d"']
    df = spark.createDataFrame(list(enumerate(queries)), "question_id int, query string")
    found = {}
    for r in websearch.phrases_of(df).collect():
        found.setdefault(r.question_id, {}).setdefault(r.alternative, []).append(tuple(r["words"]))
    for i, q in enumerate(queries):
        assert sorted(sorted(p) for p in found.get(i, {}).values()) == sorted(sorted(p) for p in websearch.parse(q))
    rng = random.Random(2)
    texts = [[rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(60)]

    def plain(alternatives, tokens):
        best = None
        for phrases in alternatives:
            if all(any(tuple(tokens[k : k + len(p)]) == p for k in range(len(tokens))) for p in phrases):
                need = [w for p in phrases for w in p]
                runs = [j - i for i in range(len(tokens)) for j in range(i + 1, len(tokens) + 1) if all(tokens[i:j].count(w) >= need.count(w) for w in need)]
                if runs:
                    best = max(best or 0, len(need) / min(runs))
        return best

    chunks = spark.createDataFrame(list(enumerate(texts)), "id int, tokens array<string>")
    got = {(r.question_id, r.id): round(r.score, 9) for r in websearch.ranked(websearch.phrases_of(df), textindex.postings(chunks.select("id", F.array_join("tokens", " ").alias("chunk_text")), ["id"]), ["id"]).collect()}
    assert got == {(i, k): round(s, 9) for i, q in enumerate(queries) for k, t in enumerate(texts) if (s := plain(websearch.parse(q), t)) is not None}


def test_stored_relations_are_built_once(spark):
    made = []
    make = lambda s, d: made.append(d) or s.range(3)
    assert stored.stored(spark, "x", "three", make).count() == stored.stored(spark, "x", "three", make).count() == 3 and made == ["x"]
