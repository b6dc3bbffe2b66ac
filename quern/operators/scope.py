"""Which documents a question may see: workspace, module or list, alive and READY. Requests are relations, so any number is resolved at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(requests: DataFrame, documents: DataFrame, shape: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """request_id, code, document_ids (sorted) of requests(request_id, workspace_id, scope_type, group_id, ids).

    WORKSPACE: the live READY documents of the workspace. MODULE: of one of its modules, which must be there.
    DOCUMENTS: of a list of distinct ids, all of which must be live documents of the workspace. code is OK,
    EMPTY_SCOPE where nothing is READY, MODULE_NOT_FOUND or SCOPE_OUTSIDE_WORKSPACE; documents only where it is OK.

    The documents of a workspace or module are found once, however many ask for it. shape is what is made of the sorted ids, before
    the requests meet them.
    """
    live = documents.where(~F.col("deleted")).select("document_id", "workspace_id", "group_id", (F.col("processing_status") == "READY").alias("ready"))
    ids = lambda ok: F.array_sort(F.collect_list(F.when(ok, F.col("document_id"))))
    scope = ["workspace_id", "scope_type", "group_id"]
    asked = requests.where("scope_type <> 'DOCUMENTS'").select(*scope).distinct()
    whole = asked.where("scope_type = 'WORKSPACE'").join(live.drop("group_id"), "workspace_id", "left").select(*scope, "document_id", "ready")
    module = asked.where("scope_type <> 'WORKSPACE'").join(live, ["workspace_id", "group_id"], "left").select(*scope, "document_id", "ready")
    wide = whole.unionByName(module).groupBy(*scope).agg(F.count("document_id").alias("n"), F.lit(0).alias("outside"), ids(F.col("ready")).alias("document_ids"))
    few = requests.where("scope_type = 'DOCUMENTS'").select("request_id", "workspace_id", F.explode_outer(F.array_distinct("ids")).alias("document_id"))
    listed = few.join(live.select("document_id", "workspace_id", "ready"), ["document_id", "workspace_id"], "left")
    lists = listed.groupBy("request_id").agg(F.count("ready").alias("n"), F.count_if(F.col("ready").isNull() & F.col("document_id").isNotNull()).alias("outside"), ids(F.col("ready")).alias("document_ids")).withColumn("scope_type", F.lit("DOCUMENTS"))
    code = F.when((F.col("scope_type") == "DOCUMENTS") & (F.col("outside") > 0), "SCOPE_OUTSIDE_WORKSPACE").when((F.col("scope_type") == "MODULE") & (F.col("n") == 0), "MODULE_NOT_FOUND").when(F.size("document_ids") == 0, "EMPTY_SCOPE").otherwise("OK")
    none = F.array().cast("array<bigint>")
    shaped = lambda rows, *key: rows.withColumn("code", code).select(*key, "code", shape(F.when(F.col("code") == "OK", F.col("document_ids")).otherwise(none)).alias("document_ids"))
    found = shaped(wide, *(F.col(c).alias(f"{c}_") for c in scope))
    same = F.lit(True)
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    of_scopes = requests.where("scope_type IS NULL OR scope_type <> 'DOCUMENTS'").select("request_id", *scope).join(found, same, "left")
    of_lists = requests.where("scope_type = 'DOCUMENTS'").select("request_id").join(shaped(lists, "request_id"), "request_id", "left")
    out = of_scopes.select("request_id", "code", "document_ids").unionByName(of_lists)
    return out.select("request_id", "code", F.coalesce("document_ids", shape(none)).alias("document_ids"))


def guard(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """request_id, document_id, verdict of requested(request_id, workspace_id, document_id): SCOPE_VIOLATION for one that is missing, deleted or of another workspace, else READY or EXCLUDED."""
    live = documents.where(~F.col("deleted")).select("document_id", "workspace_id", "processing_status")
    verdict = F.when(F.col("processing_status").isNull(), "SCOPE_VIOLATION").when(F.col("processing_status") == "READY", "READY").otherwise("EXCLUDED")
    return requested.distinct().join(live, ["document_id", "workspace_id"], "left").select("request_id", "document_id", verdict.alias("verdict"))
