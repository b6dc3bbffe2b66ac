"""Fusion of ranked lists and selection under a budget. All windows are over one query's or one document's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(scored: DataFrame, k: int, by: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first k rows, with their rank; within groups the limit is taken before the shuffle."""
    if within:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= k)
    few = scored.orderBy(*by).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # k rows


def rrf(channels: DataFrame, key: list[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of channels(key..., channel, rank): the best rank of each channel counts once."""
    best = channels.groupBy(*key, "channel").agg(F.min("rank").alias("rank"))
    order = F.array(F.lit("vector"), F.lit("keyword"), F.lit("graph"))
    return best.groupBy(*key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.array_join(F.filter(order, lambda c: F.array_contains(F.collect_set("channel"), c)), ",").alias("provenance"))


def diverse(scored: DataFrame, section: str, ident: str, budget: int) -> DataFrame:
    """The first chunk of each section first, then the others; chunks without a section are never deferred.

    Each section's first is a partial maximum. Where the firsts don't fill the budget, they are fewer than it, so whatever
    else is taken is among the best 2 * budget of all.
    """
    by, rest = [F.desc("score"), F.col(ident)], [c for c in scored.columns if c not in ("score", ident)]
    best = F.min(F.struct((-F.col("score")).alias("_score"), ident, *rest)).alias("_best")
    firsts = scored.where(F.col(section).isNotNull()).groupBy(F.col(section).alias("_section")).agg(best).select(F.expr("-_best._score").alias("score"), *(F.col(f"_best.{c}").alias(c) for c in (ident, *rest))).select(scored.columns)
    free = scored.where(F.col(section).isNull())
    others = scored.where(F.col(section).isNotNull()).orderBy(*by).limit(2 * budget).join(firsts.select(ident), ident, "left_anti").select(scored.columns)
    parts = [x.orderBy(*by).limit(budget).withColumn("deferred", F.lit(late)) for x, late in ((firsts, False), (free, False), (others, True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("deferred", *by).limit(budget).drop("deferred")


def quota(scored: DataFrame, ident: str, budget: int, share: float) -> DataFrame:
    """Round robin over documents with a cap on each one's share; the cap is lifted for the only document that exceeds it."""
    cap = max(1, -int(-budget * share // 1))
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), ident)))
    sizes = scored.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > cap).alias("over"))
    fit = ranked.where(F.col("rn") <= budget).join(F.broadcast(facts)).where((F.col("rn") <= cap) | (F.col("docs") == 1) | (F.col("over") == 1))  # facts: one row
    return fit.orderBy("rn", "document_id").limit(budget).drop("docs", "over")


def trim(candidates: DataFrame, ident: str, budget: int) -> DataFrame:
    """Drops the lowest scores of each question until its tokens fit; protected rows stay."""
    total = Window.partitionBy("question_id")
    before = Window.partitionBy("question_id").orderBy("score", ident).rowsBetween(Window.unboundedPreceding, -1)
    droppable = F.when(~F.col("protected"), F.col("token_count")).otherwise(0)
    gone = ~F.col("protected") & (F.sum("token_count").over(total) - F.coalesce(F.sum(droppable).over(before), F.lit(0)) > budget)
    return candidates.withColumn("gone", gone).where(~F.col("gone")).drop("gone")


def overlap(query_tokens: Column, tokens: Column) -> Column:
    """How many of a passage's tokens are in the query, repeats counted, over the query's distinct tokens."""
    return F.when(F.size(query_tokens) > 0, F.size(F.filter(tokens, lambda t: F.array_contains(query_tokens, t))) / F.size(query_tokens)).otherwise(0.0)
