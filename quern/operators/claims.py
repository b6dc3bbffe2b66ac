"""Drafts, claims and their verification: every answer of every question in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.stored import cut

TAG = r"(?i)\[chunk:(\d+)\]"
NOTHING_FOUND = "no supporting evidence found"


def draft_claims(text: Column) -> Column:
    """array<struct<claim, cited>> of an answer: its sentences without their chunk tags, and the first tag of each; null where there is no answer.

    A tag after the full stop belongs to the sentence before it.
    """
    moved = F.regexp_replace(F.trim(text), r"(?i)\.\s*\[chunk:(\d+)\]", " [chunk:$1].")
    parts = F.filter(T.sentences(moved), lambda s: ~s.startswith("[chunk:"))
    claims = F.transform(parts, lambda s: F.struct(F.trim(F.regexp_replace(F.regexp_replace(s, TAG, ""), r"\s+", " ")).alias("claim"), F.nullif(F.regexp_extract(s, TAG, 1), F.lit("")).cast("long").alias("cited")))
    kept = F.filter(claims, lambda c: c["claim"] != "")
    some = F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k))[0]  # as an element it is parsed once, not for its size as well
    return F.when((F.trim(text) != "") & ~F.lower(text).contains(NOTHING_FOUND), some)


def ruled_out(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """question_id, pos of the claims that a contradiction of their question rules out: those that have both values, or the label and one of them.

    An answer has few claims, so each meets its question's contradictions, equal ones once.
    """
    lower = conflicts.select("question_id", *(F.lower(c).alias(c) for c in ("label", "left_value", "right_value"))).distinct()
    c = claims.select("question_id", "pos", F.lower("claim").alias("low")).join(lower, "question_id")
    has = lambda name: F.col("low").contains(F.col(name))
    left, right = has("left_value"), has("right_value")
    return c.where((left & right) | (has("label") & (left | right))).select("question_id", "pos").distinct()


def verify(claims: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """claims(question_id, pos, claim, cited) with cited, supported_by_text, supported_by_graph, is_supported.

    evidence(question_id, chunk_id, place, text): a claim that cites one of its question's chunks is held against that one,
    any other against all of them, and takes the first that supports it. conflicts(question_id, label, left_value, right_value)
    are the graph's contradictions, see ruled_out.
    """
    e = evidence.select("question_id", "chunk_id", "place", F.col("text").alias("passage"), T.bare_words(F.col("text")).alias("tokens"))
    own = evidence.select("question_id", F.col("chunk_id").alias("cited"), F.lit(True).alias("known"))
    # written once: parsing the drafts is the dearest part, and the claims are read for their evidence, conflicts and result
    c = cut(claims.join(own, ["question_id", "cited"], "left").withColumn("known", F.coalesce("known", F.lit(False))), "claims")
    supports = T.text_support(F.col("claim"), F.col("words"), F.col("passage"), F.col("tokens"))
    meets = ~F.col("known") | (F.col("cited") == F.col("chunk_id"))
    both = c.withColumn("words", T.claim_words(F.col("claim"))).join(e, "question_id").where(meets).where(supports)
    first = both.groupBy("question_id", "pos").agg(F.min_by("chunk_id", F.struct("place", "chunk_id")).alias("support"))
    bad = ruled_out(c, conflicts).withColumn("conflict", F.lit(True))
    out = c.join(first, ["question_id", "pos"], "left").join(bad, ["question_id", "pos"], "left")
    text, graph = F.col("support").isNotNull(), F.col("conflict").isNull()
    return out.select("question_id", "pos", "claim", F.when(F.col("known"), F.col("cited")).otherwise(F.col("support")).alias("cited"), text.alias("supported_by_text"), graph.alias("supported_by_graph"), (text & graph).alias("is_supported"))


def answers(verified: DataFrame, top_score: DataFrame) -> DataFrame:
    """question_id, answer, n_claims, n_supported, confidence, is_not_found of verified claims; top_score(question_id, top) is the best evidence's score.

    Confidence: seven tenths the share of supported claims and three tenths the best score (0.5 without evidence), between 0.1 and 1.
    """
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_supported"), F.struct("pos", "claim")))), lambda x: x["claim"])
    a = verified.groupBy("question_id").agg(F.array_join(kept, " ").alias("answer"), F.count(F.lit(1)).alias("n_claims"), F.count_if("is_supported").alias("n_supported"))
    share = F.col("n_supported") / F.col("n_claims") * 0.7 + F.coalesce("top", F.lit(0.5)) * 0.3
    found = F.col("n_supported") > 0
    return a.join(top_score, "question_id", "left").select("question_id", F.when(found, F.col("answer")).otherwise("").alias("answer"), "n_claims", "n_supported", F.when(found, F.least(F.lit(1.0), F.greatest(F.lit(0.1), share))).otherwise(0.0).alias("confidence"), (~found).alias("is_not_found"))


def events(answered: DataFrame) -> DataFrame:
    """question_id, type, ordinal, payload of answered(question_id, answer, is_not_found): the answer's text in pieces as token events, then done."""
    event = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.alias("payload"))
    tokens = F.when(F.length("answer") > 0, F.transform(T.pieces(F.col("answer")), lambda p: event("token", p)))
    done = F.array(event("done", F.col("is_not_found").cast("string")))
    every = F.when(tokens.isNull(), done).otherwise(F.concat(tokens, done))
    return answered.select("question_id", F.posexplode(every).alias("ordinal", "e")).select("question_id", "e.type", "ordinal", "e.payload")


def error_event(code: str) -> list[Column]:
    return [F.lit("error").alias("type"), F.lit(0).alias("ordinal"), F.lit(code).alias("payload")]
