"""Queries of drafts, claims, citations, answers and their events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as T
from quern.operators import claims as C
from quern.queries.answers import _CUT
from quern.queries.texts import _BARE, _LIST
from quern.registry import query
from quern.sources import store as S
from quern.sources import views as V

A, CL = S.AGREEMENTS, S.CLAUSES

# The generator's drafts: for each agreement a text of four sentences with tags; its evidence are the agreement's chunks.
_DRAFT = "concat(title, ' is in force. [chunk:', CAST(2 * document_id AS STRING), '] The expiry date is 2001-06-30 or 2002-06-30 [chunk:', CAST(2 * document_id + CASE WHEN document_id % 3 = 0 THEN 1 ELSE 0 END AS STRING), ']. Vela Corp keeps the keys. Nothing whatever grows underneath purple mountains [chunk:7].')"
_TEXT = f"CASE WHEN document_id % 13 = 0 THEN 'No supporting evidence found.' WHEN document_id % 17 = 0 THEN ' ' ELSE {_DRAFT} END"
_DR = f"drafts AS (SELECT document_id AS question_id, {_TEXT.replace('AS STRING', 'AS VARCHAR')} AS draft FROM agreements WHERE processing_status = 'READY' AND NOT deleted)"
#: From drafts(question_id, draft) to claims(question_id, pos, claim, cited).
PARSE = r"""moved AS (SELECT question_id, regexp_replace(trim(draft), '\.\s*\[chunk:(\d+)\]', ' [chunk:\1].', 'g') AS m FROM drafts WHERE trim(draft) <> '' AND NOT contains(lower(draft), 'no supporting evidence found')),
sent AS (SELECT question_id, list_filter(list_filter(list_transform(string_split(regexp_replace(m, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: NOT starts_with(x, '[chunk:')) AS s FROM moved),
said AS (SELECT question_id, unnest(range(len(s))) AS pos, unnest(s) AS t FROM sent),
claims AS (SELECT question_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(t, '\[chunk:\d+\]', '', 'g'), '\s+', ' ', 'g')) AS claim, TRY_CAST(nullif(regexp_extract(t, '\[chunk:(\d+)\]', 1), '') AS BIGINT) AS cited FROM said)"""
#: From claims, ev(question_id, chunk_id, place, passage) and con(question_id, label, lv, rv) to ver.
JUDGE = f"""k AS (SELECT c.*, e.chunk_id IS NOT NULL AS known FROM claims c LEFT JOIN ev e ON e.question_id = c.question_id AND e.chunk_id = c.cited),
w AS (SELECT k.*, e.chunk_id, e.place, lower(trim(k.claim)) AS lc, lower(e.passage) AS lp, list_filter({_BARE.format('k.claim')}, lambda x: NOT list_contains({_LIST(T.STOPWORDS)}, x) AND length(x) > 2) AS cw, {_BARE.format('e.passage')} AS pw FROM k JOIN ev e ON e.question_id = k.question_id AND (NOT k.known OR k.cited = e.chunk_id)),
h AS (SELECT * FROM w WHERE contains(lp, lc) OR (len(cw) > 0 AND len(list_filter(cw, lambda x: list_contains(pw, x))) >= 0.25 * len(cw))),
f AS (SELECT question_id, pos, arg_min(chunk_id, place * 1000000000 + chunk_id) AS support FROM h GROUP BY ALL),
bad AS (SELECT DISTINCT c.question_id, c.pos FROM claims c JOIN con ON con.question_id = c.question_id WHERE (contains(lower(claim), lv) AND contains(lower(claim), rv)) OR (contains(lower(claim), label) AND (contains(lower(claim), lv) OR contains(lower(claim), rv)))),
ver AS (SELECT k.question_id, k.pos, k.claim, CASE WHEN k.known THEN k.cited ELSE f.support END AS cited, f.support IS NOT NULL AS supported_by_text, bad.pos IS NULL AS supported_by_graph, f.support IS NOT NULL AND bad.pos IS NULL AS is_supported FROM k LEFT JOIN f ON f.question_id = k.question_id AND f.pos = k.pos LEFT JOIN bad ON bad.question_id = k.question_id AND bad.pos = k.pos)"""
#: From ver and top(question_id, top) to ans.
ANSWER = "a AS (SELECT question_id, count(*) AS n_claims, count(*) FILTER (WHERE is_supported) AS n_supported, string_agg(claim, ' ' ORDER BY pos) FILTER (WHERE is_supported) AS answer FROM ver GROUP BY 1), ans AS (SELECT a.question_id, coalesce(answer, '') AS answer, n_claims, n_supported, round(CASE WHEN n_supported > 0 THEN least(1, greatest(0.1, 0.7 * n_supported / n_claims + 0.3 * coalesce(top, 0.5))) ELSE 0 END::DOUBLE, 6) AS confidence, n_supported = 0 AS is_not_found FROM a LEFT JOIN top ON top.question_id = a.question_id)"
_CLAIMS = f"{A}, {CL}, {_DR}, {PARSE}"
_VER = f"""{_CLAIMS}, ev AS (SELECT document_id AS question_id, chunk_id, page_number AS place, chunk_text AS passage FROM clauses),
con AS (SELECT document_id AS question_id, 'expiry date' AS label, '2001-06-30' AS lv, '2002-06-30' AS rv FROM agreements WHERE document_id % 2 = 0), {JUDGE}"""


def drafts(spark, sf):
    return S.ready(spark, sf).selectExpr("document_id AS question_id", f"{_TEXT} AS draft")


def claims(spark, sf):
    return drafts(spark, sf).select("question_id", F.posexplode_outer(C.draft_claims(F.col("draft"))).alias("pos", "c")).where("c is not null").select("question_id", "pos", "c.claim", "c.cited")


def evidence(spark, sf):
    return S.clauses(spark, sf).select(F.col("document_id").alias("question_id"), "chunk_id", F.col("page_number").alias("place"), F.col("chunk_text").alias("text"))


def conflicts(spark, sf):
    return S.agreements(spark, sf).where("document_id % 2 = 0").select(F.col("document_id").alias("question_id"), F.lit("expiry date").alias("label"), F.lit("2001-06-30").alias("left_value"), F.lit("2002-06-30").alias("right_value"))


def verified(spark, sf):
    return C.verify(claims(spark, sf), evidence(spark, sf), conflicts(spark, sf))


@query(f"WITH {_CLAIMS} SELECT * FROM claims")
def parse_draft(spark, sf):
    return claims(spark, sf)


@query(f"WITH {_VER} SELECT * FROM ver")
def claim_verify(spark, sf):
    """Every claim against its cited chunk, or the first that supports it, and against the graph's contradictions."""
    return verified(spark, sf)


@query(f"WITH {_VER} SELECT question_id, pos FROM bad")
def claim_conflict(spark, sf):
    """The claims that a contradiction rules out."""
    return verified(spark, sf).where(~F.col("supported_by_graph")).select("question_id", "pos")


_TOP = "top AS (SELECT document_id AS question_id, max(CAST(chunk_id % 10 AS DOUBLE) / 10) AS top FROM clauses WHERE document_id % 9 <> 4 GROUP BY 1)"


def _tops(spark, sf):
    return S.clauses(spark, sf).where("document_id % 9 <> 4").groupBy(F.col("document_id").alias("question_id")).agg(F.max(F.col("chunk_id") % 10 / 10).alias("top"))


_ANS = f"{_VER}, {_TOP}, {ANSWER}"


def answers(spark, sf):
    return C.answers(verified(spark, sf), _tops(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_ANS} SELECT * FROM ans")
def agg_claim_support(spark, sf):
    """The answer that is left of the supported claims, and its confidence."""
    return answers(spark, sf)


@query(f"WITH {_ANS} SELECT d.question_id, coalesce(nullif(answer, ''), 'No supporting evidence was found.') AS answer, coalesce(is_not_found, true) AS is_not_found FROM drafts d LEFT JOIN ans ON ans.question_id = d.question_id")
def not_found(spark, sf):
    """Every question has an answer: the fixed one where no claim is left, or none was made."""
    a = answers(spark, sf).select("question_id", "answer", "is_not_found")
    return drafts(spark, sf).select("question_id").join(a, "question_id", "left").select("question_id", F.coalesce(F.nullif("answer", F.lit("")), F.lit("No supporting evidence was found.")).alias("answer"), F.coalesce("is_not_found", F.lit(True)).alias("is_not_found"))


_CIT = f"{_VER}, u AS (SELECT DISTINCT question_id, cited AS chunk_id FROM ver WHERE is_supported AND cited IS NOT NULL), cit AS (SELECT u.question_id, u.chunk_id, c.document_id, c.page_number, substr(c.chunk_text, 1, 200) AS source_excerpt, row_number() OVER (PARTITION BY u.question_id ORDER BY c.page_number, u.chunk_id) - 1 AS ordinal FROM u JOIN clauses c ON c.chunk_id = u.chunk_id)"


def citations(spark, sf):
    used = verified(spark, sf).where("is_supported AND cited IS NOT NULL").select("question_id", F.col("cited").alias("chunk_id")).distinct()
    w = Window.partitionBy("question_id").orderBy("page_number", "chunk_id")
    return used.join(S.clauses(spark, sf), "chunk_id").select("question_id", "chunk_id", "document_id", "page_number", F.substring("chunk_text", 1, 200).alias("source_excerpt"), (F.row_number().over(w) - 1).alias("ordinal"))


@query(f"WITH {_CIT} SELECT * FROM cit")
def citation_persist(spark, sf):
    """The citations of each answer: every chunk that a supported claim rests on, numbered from 0."""
    return citations(spark, sf)


@query(f"WITH {_CIT} SELECT c.question_id, c.chunk_id, a.document_id IS NOT NULL AND c.document_id = c.chunk_id // 2 AS valid FROM cit c LEFT JOIN (SELECT document_id FROM agreements WHERE NOT deleted AND processing_status = 'READY') a ON a.document_id = c.document_id")
def validate_citation(spark, sf):
    """A citation's document must be in scope and its chunk one of the document's."""
    scope = S.ready(spark, sf).select("document_id", F.lit(True).alias("there"))
    return citations(spark, sf).join(scope, "document_id", "left").select("question_id", "chunk_id", (F.coalesce("there", F.lit(False)) & (F.col("document_id") == F.floor(F.col("chunk_id") / 2))).alias("valid"))


@query(f"WITH {A}, {CL} SELECT a.document_id AS question_id, 'See the first passage in scope.' AS answer, min(c.chunk_id) AS chunk_id FROM agreements a LEFT JOIN clauses c ON c.document_id = a.document_id WHERE a.processing_status = 'READY' AND NOT a.deleted GROUP BY 1")
def stub_answer(spark, sf):
    """A canned answer that cites the first chunk in scope."""
    first = S.clauses(spark, sf).groupBy("document_id").agg(F.min("chunk_id").alias("chunk_id"))
    return S.ready(spark, sf).select("document_id").join(first, "document_id", "left").select(F.col("document_id").alias("question_id"), F.lit("See the first passage in scope.").alias("answer"), "chunk_id")


@query(
    f"""WITH RECURSIVE {_ANS}, cut AS (SELECT question_id, -1 AS pos, '' AS piece, answer AS rest FROM ans UNION ALL SELECT question_id, pos + 1, substr(rest, 1, {_CUT}), substr(rest, {_CUT} + 1) FROM cut WHERE length(rest) > 0),
n AS (SELECT question_id, CAST(max(pos) + 1 AS INTEGER) AS n FROM cut GROUP BY ALL)
SELECT question_id, 'token' AS type, pos AS ordinal, piece AS payload FROM cut WHERE pos >= 0 UNION ALL SELECT n.question_id, 'done', n.n, CAST(is_not_found AS VARCHAR) FROM ans JOIN n ON n.question_id = ans.question_id UNION ALL SELECT question_id, 'error', 0, 'EMPTY_DRAFT' FROM drafts WHERE trim(draft) = ''"""
)
def event_constructors(spark, sf):
    """The events of each answer: token events with all of its text, in pieces, then done; an error where the draft is empty."""
    return C.events(answers(spark, sf)).unionByName(drafts(spark, sf).where("trim(draft) = ''").select("question_id", *C.error_event("EMPTY_DRAFT")))


@query("WITH a AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant') SELECT conv_id AS session_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS n_events FROM a GROUP BY 1")
def facade_ask(spark, sf):
    """The answer without a stream: its pieces put together again."""
    pieces = V.table(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), "turn", F.posexplode_outer(T.pieces(F.col("text"))).alias("k", "piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "k", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("session_id").agg(whole.alias("answer"), F.count_distinct("turn").alias("n_events"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'INVALID_REQUEST' WHEN item_id % 3 = 1 THEN 'OK' ELSE 'INVALID_REQUEST' END AS code, CASE WHEN item_id % 3 = 1 THEN text END AS question FROM benchmark")
def request_parse(spark, sf):
    """Requests as JSON: one that can't be read, or has no workspace or question, is refused."""
    i = F.col("item_id")
    good = F.to_json(F.struct(F.lit("w1").alias("workspaceId"), F.col("text").alias("question")))
    body = F.when(i % 3 == 0, F.lit('{"workspaceId": ')).when(i % 3 == 1, good).otherwise(F.to_json(F.struct(F.col("text").alias("question"))))
    r = F.from_json(body, "workspaceId string, question string", {"mode": "PERMISSIVE"})
    ok = F.coalesce(r["workspaceId"].isNotNull() & (F.trim(r["question"]) != ""), F.lit(False))
    return V.table(spark, sf, "benchmark").select("item_id", F.when(ok, "OK").otherwise("INVALID_REQUEST").alias("code"), F.when(ok, r["question"]).alias("question"))


@query(f"WITH {A} SELECT workspace_id, CASE WHEN count(*) FILTER (WHERE processing_status = 'FAILED') > 2 THEN 'FAILED' ELSE 'OK' END AS graph_status, CASE WHEN count(*) FILTER (WHERE processing_status = 'FAILED') > 2 THEN 0 ELSE count(*) END AS n_graph FROM agreements GROUP BY 1")
def degrade_graph(spark, sf):
    """A graph that fails leaves an empty channel and its status, and the answer goes on."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col("processing_status") == "FAILED") > 2
    return S.agreements(spark, sf).groupBy("workspace_id").agg(F.when(bad, "FAILED").otherwise("OK").alias("graph_status"), F.when(bad, 0).otherwise(n).alias("n_graph"))


@query(f"WITH {_CLAIMS}, p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT d.question_id, CASE WHEN trim(draft) = '' THEN 'FAILED' WHEN c.n IS NULL THEN 'EMPTY' ELSE 'COMPLETED' END AS status, coalesce(c.n, 0) AS n_claims FROM drafts d LEFT JOIN (SELECT question_id, count(*) AS n FROM claims GROUP BY 1) c ON c.question_id = d.question_id")
def stage_machine(spark, sf):
    """Each row carries its own status through the stages: a failure stops the row, not the job."""
    n = claims(spark, sf).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    d = drafts(spark, sf).join(n, "question_id", "left")
    return d.select("question_id", F.when(F.trim("draft") == "", "FAILED").when(F.col("n").isNull(), "EMPTY").otherwise("COMPLETED").alias("status"), F.coalesce("n", F.lit(0)).alias("n_claims"))
