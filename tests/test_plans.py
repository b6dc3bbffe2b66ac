"""What plans of the queries must not do twice, or in one task."""

from pyspark.sql import functions as F

from quern import queries as own
from quern.functions import rules as R
from quern.operators import textindex as TI
from quern.queries import fields as FQ
from quern.sources import store as S

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_are_made_once(spark):
    """An inner generator over a column of fields had them made three times, to find out whether there is one."""
    for name in ("validate_provenance", "extract_universal_rules", "dedupe_extracted_fields", "split_parties", "parse_amount"):
        assert plan_of(own.queries()[name](spark, SF)).count("Effective Date[") == 1
    assert plan_of(TI.gram_postings(spark.createDataFrame([(1, "some words")], "k int, chunk_text string"), ["k"])).count("flatten") == 1


def test_amounts_are_labelled(spark):
    texts = ["Price: $1,200.50", "no amount: 12", "a: $1", "x" * 40 + " total:\n$7. Then fee : $9, Net:$3.1", "$5", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", R.amounts(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == [["Price: $1,200.50"], [], [], ["x" * 24 + " total: $7", "Then fee: $9,", "Net: $3"], [], None]


def test_one_row_group_is_many_tasks(spark, tmp_path):
    """A scan that is cut into many parts has all rows in one of them if the file has one row group."""
    spark.read.parquet(f"{SF}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert S.table(spark, str(tmp_path), "orders").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert S.clauses(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert FQ.universal(spark, str(tmp_path)).count() == FQ.universal(spark, SF).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_scope_is_resolved_once(spark):
    """The documents of a module were joined and listed for each request for it."""
    aggregates = [x for x in plan_of(own.queries()["scope_resolve_module"](spark, SF)).splitlines() if "Aggregate" in x and "collect_list" in x]
    assert any("group_id" in x and "request_id" not in x for x in aggregates)


def test_only_fields_that_give_candidates_are_made(spark):
    """All fields of a document were made for the graph, titles and references too, and groups of them grew with the input."""
    df = own.queries()["kg_extract_fields"](spark, SF)
    plan = plan_of(df)
    assert "Effective Date[" in plan and "ref(?:erence)" not in plan
    assert "RepartitionByExpression [chunk_id" in plan
