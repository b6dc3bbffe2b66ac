"""The stages of each document as a stream: state by document, retries, stalled documents, and status rows that are written exactly once.

Events may come twice, in any order, and as late as `lateness` of event time (Spark drops later ones): of a stage the event with
the greatest number counts, and failures are counted by their numbers, so the status after all events is the one that a batch
over them gives (`folded`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The stages in order; a stage that failed so often is given up.
STAGES, FAILURES = ["click", "purchase", "view"], 3
STATUS = "document_id bigint, status string, stage string, last_event bigint"
_LATEST = "stages array<string>, numbers array<bigint>, statuses array<string>"
STATE = f"{_LATEST}, failed_stages array<string>, failed_numbers array<bigint>"


def status_of(latest: dict[str, tuple[int, str]], failed: dict[str, set[int]], stages: list[str]) -> tuple[str, str | None]:
    """The status of a document and the stage that it is at: given up, to be tried again, ready, or under way."""
    failing = [s for s in stages if s in latest and latest[s][1] == "FAILED"]
    given_up = [s for s in failing if len(failed.get(s, ())) >= FAILURES]
    if given_up:
        return "FAILED", given_up[0]
    if failing:
        return "RETRYING", failing[0]
    open_stages = [s for s in stages if s not in latest or latest[s][1] != "COMPLETED"]
    return ("PROCESSING", open_stages[0]) if open_stages else ("READY", None)


def watched(events: DataFrame, stages: list[str] = STAGES, lateness: str = "1 hour", stall_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A status row for each document that a micro-batch of events(document_id, event_id, stage, status, ts) changes; a document that isn't ready, nor given up, and has no event for stall_ms of event time is STALLED.

    A document's state is bounded: the latest event of each stage, and FAILURES failures of each at most.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, failed = {}, {}
        if state.exists:
            names, numbers, statuses, failed_stages, failed_numbers = state.get
            latest = {s: (int(n), x) for s, n, x in zip(names, numbers, statuses, strict=True)}
            for s, n in zip(failed_stages, failed_numbers, strict=True):
                failed.setdefault(s, set()).add(int(n))
        newest, changed = 0, False
        for part in parts:
            for n, s, x, ts in zip(part["event_id"], part["stage"], part["status"], part["ts"], strict=True):
                n = int(n)
                newest = max(newest, int(ts.timestamp() * 1000) if pd.notna(ts) else 0)
                if s not in latest or n > latest[s][0]:
                    latest[s], changed = (n, x), True
                if x == "FAILED" and len(failed.setdefault(s, set())) < FAILURES and n not in failed[s]:
                    failed[s].add(n)
                    changed = True
        status, stage = status_of(latest, failed, stages)
        last = max(n for n, _ in latest.values())
        if state.hasTimedOut:
            status, changed = "STALLED", True
        else:
            pairs = sorted((s, n) for s, ns in failed.items() for n in ns)
            state.update(([*latest], [n for n, _ in latest.values()], [x for _, x in latest.values()], [s for s, _ in pairs], [n for _, n in pairs]))
            if status not in ("READY", "FAILED"):
                state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + stall_ms)
        if changed:
            yield pd.DataFrame({"document_id": [key[0]], "status": [status], "stage": [stage], "last_event": [last]})

    rows = events.withWatermark("ts", lateness).groupBy("document_id")
    return rows.applyInPandasWithState(step, STATUS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run(spark: SparkSession, events: DataFrame, folder: str, **options) -> DataFrame:
    """Runs a stream of events as far as it goes and returns each document's last status. Each batch's rows lie under its number, so a batch that is run again, after a restart too, replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    watched(events, **options).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return statuses(spark, folder)


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """The last status of each document: that of the greatest batch."""
    rows = spark.read.schema(f"{STATUS}, batch int").parquet(f"{folder}/rows")
    best = F.max_by(F.struct("status", "stage", "last_event"), "batch")
    return rows.groupBy("document_id").agg(best.alias("b")).select("document_id", "b.*")


def folded(events: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """The same statuses from all events at once, in two aggregations."""
    by = events.groupBy("document_id", "stage").agg(F.max_by("status", "event_id").alias("status"), F.max("event_id").alias("last"), F.count_distinct(F.when(F.col("status") == "FAILED", F.col("event_id"))).alias("failures"))
    failing = F.col("status") == "FAILED"
    known = by.withColumn("place", F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))).where("place > 0")
    first = lambda c, name: F.min(F.when(c, F.col("place"))).alias(name)
    some = known.groupBy("document_id").agg(first(failing & (F.col("failures") >= FAILURES), "given_up"), first(failing, "failing"), F.array_sort(F.collect_set(F.when(F.col("status") == "COMPLETED", F.col("place")))).alias("done"))  # places: one for each stage
    last = by.groupBy("document_id").agg(F.max("last").alias("last_event"))
    names = F.array(*map(F.lit, stages))
    open_places = F.filter(F.sequence(F.lit(1), F.lit(len(stages))).cast("array<bigint>"), lambda p: ~F.array_contains(F.coalesce("done", F.array().cast("array<bigint>")), p))
    d = last.join(some, "document_id", "left").withColumn("open", F.get(open_places, 0))
    status = F.when(F.col("given_up").isNotNull(), "FAILED").when(F.col("failing").isNotNull(), "RETRYING").when(F.col("open").isNotNull(), "PROCESSING").otherwise("READY")
    at = F.coalesce("given_up", "failing", "open")
    return d.select("document_id", status.alias("status"), F.get(names, (at - 1).cast("int")).alias("stage"), "last_event")
