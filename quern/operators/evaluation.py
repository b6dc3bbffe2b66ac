"""How well rankings find what they should: recall, nDCG and the first hit, by mode, and each mode against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_document(ranked: DataFrame) -> DataFrame:
    """mode, question_id, document_id, rank of ranked(mode, question_id, document_id, rank) of passages: a document stands where its best passage does, ties by document_id."""
    best = ranked.groupBy("mode", "question_id", "document_id").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("mode", "question_id").orderBy("best", "document_id"))).drop("best")


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def report(documents: DataFrame, gold: DataFrame, modes: list[str], k: int = 10) -> DataFrame:
    """mode, n_questions, recall, ndcg, first of documents(mode, question_id, document_id, rank) up to rank k, averaged over the questions of gold(question_id, document_id), and what each has beyond the first of modes. A question that a mode finds nothing for counts 0."""
    wanted = gold.select("question_id", "document_id").distinct()
    each = wanted.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), gain), F.lit(0.0), lambda a, x: a + x)
    every = each.select("question_id", "n", ideal.alias("ideal"), F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    hits = documents.where(F.col("rank") <= k).join(wanted, ["question_id", "document_id"]).groupBy("mode", "question_id").agg(F.count(F.lit(1)).alias("found"), F.sum(gain(F.col("rank"))).alias("dcg"), F.min("rank").alias("at"))
    q = every.join(hits, ["mode", "question_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means = q.groupBy("mode").agg(F.count(F.lit(1)).alias("n_questions"), F.avg(zero(F.col("found") / F.col("n"))).alias("recall"), F.avg(zero(F.col("dcg") / F.col("ideal"))).alias("ndcg"), F.avg(zero((F.col("at") == 1).cast("double"))).alias("first"))
    base = Window.partitionBy(F.lit(1))  # a row for each mode
    of_base = lambda c: F.max(F.when(F.col("mode") == modes[0], F.col(c))).over(base)
    return means.select("mode", "n_questions", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "first")), *(F.round(F.col(c) - of_base(c), 6).alias(f"{c}_delta") for c in ("recall", "ndcg", "first")))
