"""The queries of this subpackage: opN_<name>, and pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import decontaminate

    return decontaminate.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import ann

    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op3_elias_fano_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import ngram

    return ngram.scores(documents(spark, sf_dir))


def op4_pivot_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import jaccard

    return jaccard.linked(documents(spark, sf_dir))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import toxicity

    return toxicity.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_arrow_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import token_store

    return token_store.read_back(token_store.write(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=1))


def op7_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import secrets

    return secrets.digests(documents(spark, sf_dir))


def op8_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import substrings

    return substrings.digests(documents(spark, sf_dir))


def op9_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import sharding

    return sharding.digests(documents(spark, sf_dir))


def op10_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import bpe

    return bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op11_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import simhash

    return simhash.linked(documents(spark, sf_dir))


def op12_kdtree_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import kdtree

    return kdtree.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_radix_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import divergence

    return divergence.audit(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op12_kdtree_filtering": sql.clusters(), "op13_radix_divergence": sql.DIVERGENCE}
