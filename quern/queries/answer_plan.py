"""Queries of the whole way from questions to answers: drafts of the package's own passages, claims held against them and the built graph's contradictions, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import claims as C
from quern.plans import answer as AP
from quern.queries import claims as CQ
from quern.queries import evidence as EQ
from quern.queries import kg as G
from quern.registry import query
from quern.sources.stored import cut, stored

_DRAFTS = f"""{EQ._WHOLE}, psg AS (SELECT k.question_id, k.chunk_id, k.document_id, k.score, CAST(row_number() OVER (PARTITION BY k.question_id ORDER BY k.score DESC, k.chunk_id) AS INTEGER) AS place, c.chunk_text AS passage, c.page_number, a.title, CASE WHEN c.page_number = 2 THEN 'annex' END AS heading FROM kept k JOIN clauses c ON c.chunk_id = k.chunk_id JOIN agreements a ON a.document_id = k.document_id),
ln AS (SELECT question_id, place, chunk_id, unnest(range(len(l))) AS ix, unnest(l) AS line FROM (SELECT *, list_transform(string_split(title || coalesce(' (' || heading || ')', '') || ' [Page ' || page_number || ']' || chr(10) || trim(passage), chr(10)), lambda x: trim(x)) AS l FROM psg)),
l3 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, ix) AS nth FROM ln WHERE length(line) > 10 QUALIFY nth <= 3),
drafts AS (SELECT s.question_id, coalesce(string_agg(line || ' [chunk:' || chunk_id || ']', ' ' ORDER BY nth), 'No supporting evidence found in the selected documents.') AS draft FROM sq s LEFT JOIN l3 USING (question_id) GROUP BY 1)"""
_PLAN = f"""{_DRAFTS}, {CQ.PARSE}, ev AS (SELECT question_id, chunk_id, place, passage FROM psg), {CQ.JUDGE}, top AS (SELECT question_id, max(score) AS top FROM psg GROUP BY 1), {CQ.ANSWER}"""


def passages(spark, sf):
    return stored(spark, sf, "passages", lambda s, d: AP.passages(EQ.kept(s, d), EQ.chunks(s, d), G.live(s, d)))


def drafts(spark, sf):
    return AP.drafts(EQ.questions(spark, sf), passages(spark, sf))


def verified(spark, sf):
    evidence = passages(spark, sf).select("question_id", "chunk_id", "place", "text")
    claims = cut(AP.claims_of(drafts(spark, sf)), "claims-of-drafts")
    return C.verify(claims, evidence, EQ.conflicts(spark, sf, claims))


@query(f"{_DRAFTS} SELECT * FROM drafts")
def draft_of_package(spark, sf):
    """The rules' draft of every question: the first lines of its package's passages, each with the tag of its chunk."""
    return drafts(spark, sf)


@query(f"{EQ._WHOLE} SELECT question_id, fact_type, label, lv AS left_value, rv AS right_value, ld AS left_document_id, rd AS right_document_id FROM con")
def contradiction_pairs(spark, sf):
    """The contradictions of each package: both sides in its question's scope, with their values and documents."""
    return EQ.contradictions(spark, sf).select("question_id", "fact_type", "label", "left_value", "right_value", "left_document_id", "right_document_id")


@query(f"{_PLAN} SELECT * FROM ver")
def verify_package(spark, sf):
    """Every claim of the drafts, held against the package's passages and the contradictions of its scope."""
    return verified(spark, sf)


@query(f"""{_PLAN}, u AS (SELECT DISTINCT question_id, cited AS chunk_id FROM ver WHERE is_supported AND cited IS NOT NULL),
cits AS (SELECT u.question_id, string_agg(u.chunk_id || '@' || page_number || ' ' || title || ': ' || substr(passage, 1, 200), '|' ORDER BY page_number, u.chunk_id) AS citations FROM u JOIN psg p ON p.question_id = u.question_id AND p.chunk_id = u.chunk_id GROUP BY 1)
SELECT s.question_id, CASE WHEN coalesce(is_not_found, true) THEN 'No supporting evidence was found.' ELSE answer END AS answer, coalesce(n_claims, 0) AS n_claims, coalesce(n_supported, 0) AS n_supported, round(coalesce(confidence, 0), 2) AS confidence, coalesce(is_not_found, true) AS is_not_found, coalesce(citations, '') AS citations
FROM sq s LEFT JOIN ans USING (question_id) LEFT JOIN cits USING (question_id)""")
def answer_package(spark, sf):
    """The answer to every question: what is left of its claims, its confidence, and the passages that it rests on."""
    a = AP.answered(EQ.questions(spark, sf), passages(spark, sf), verified(spark, sf))
    shown = F.transform("citations", lambda c: F.concat(c["chunk_id"].cast("string"), F.lit("@"), c["page_number"].cast("string"), F.lit(" "), c["document_name"], F.lit(": "), c["source_excerpt"]))
    return a.withColumn("citations", F.array_join(shown, "|"))
