"""The retrieval plan: channels, fusion, selection, for a question and any number of chunks.

Both channels score the chunks in one scan, whose scores are written once; each keeps 20 of them by
TakeOrderedAndProject, so the shuffle carries 20 rows a task, and everything after is on 40 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.functions import text as T
from quern.operators import fusion
from quern.sources.stored import cut


def retrieve(chunks: DataFrame, question: DataFrame, channel_k: int = 20, budget: int = 8) -> DataFrame:
    """document_id, pos, rrf_score, provenance of the best chunks for question(text), one row."""
    asked = question.select(F.array_distinct(T.simple_tokens(F.col("text"))).alias("qt"), S.hashed_slots(F.col("text")).alias("qs"))
    q = asked.select("qt", S.slot_counts(F.col("qs")).alias("weights"), S.squared_norm(F.col("qs")).alias("norm"))
    # slots and tokens are columns of their own: inside a lambda they would be computed for each element
    parts = chunks.select("document_id", "pos", S.hashed_slots(F.col("chunk_text")).alias("cs"), T.simple_tokens(F.col("chunk_text")).alias("ct"))
    cosine = S.bag_cosine(F.col("cs"), F.col("weights"), F.col("norm"))
    scored = cut(parts.join(F.broadcast(q)).select("document_id", "pos", F.round(cosine, 9).alias("vector"), F.round(fusion.overlap(F.col("qt"), F.col("ct")), 9).alias("keyword")), "scores")  # q: one row
    lists = [fusion.top(scored.select("document_id", "pos", c), channel_k, [F.desc(c), F.col("document_id"), F.col("pos")]).select("document_id", "pos", "rank", F.lit(c).alias("channel")) for c in ("vector", "keyword")]
    fused = fusion.rrf(lists[0].unionByName(lists[1]), ["document_id", "pos"])
    return fused.orderBy(F.desc("rrf_score"), "document_id", "pos").limit(budget).select("document_id", "pos", F.round("rrf_score", 9).alias("rrf_score"), "provenance")
