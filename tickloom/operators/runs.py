"""Read side of the run registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_runs(runs: DataFrame, owner: object, offset: int, limit: int) -> DataFrame:
    """One page of an owner's runs, newest first. The limit is the feature; Spark runs it as a top-k per partition."""
    return runs.filter((F.col("owner_id") == owner) & ~F.col("deleted")).orderBy(F.col("queued_at").desc(), "run_id").offset(offset).limit(limit)


def overview(runs: DataFrame) -> DataFrame:
    reason = F.when(F.col("status") == "UNAVAILABLE", F.col("unavailable_reason")).when(F.col("status") == "FAILED", F.col("failure_code"))
    return runs.withColumn("reason_code", reason)


def attempt_counts(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    counts = attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    return runs.join(counts, "run_id", "left").withColumn("attempts", F.coalesce("_n", F.lit(0))).drop("_n")


def inputs_and_models(runs: DataFrame, pins: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs with their pinned datasets; pins per run are bounded by the run's plan."""
    listed = pins.join(datasets, "dataset_id").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pins"), F.array_join(F.array_sort(F.collect_set("dataset_name")), ",").alias("dataset_names")
    )
    return runs.join(listed, "run_id", "left")


def stale_runs(runs: DataFrame, latest: DataFrame, now: object, max_attempts: int) -> DataFrame:
    """Report of active runs: LIVE, CANCELLED, EXHAUSTED, LEASE_EXPIRED or INCONSISTENT. Nothing is changed."""
    joined = runs.filter(F.col("status").isin("QUEUED", "RUNNING")).join(latest, "run_id", "left")
    live = (F.col("attempt_status") == "RUNNING") & (F.col("lease_expires_at") > F.lit(now).cast("timestamp"))
    finding = (
        F.when(F.coalesce(live, F.lit(False)), "LIVE")
        .when(F.col("cancel_requested"), "CANCELLED")
        .when(F.coalesce("attempt_number", F.lit(0)) >= max_attempts, "EXHAUSTED")
        .when((F.col("status") == "RUNNING") & F.col("attempt_number").isNull(), "INCONSISTENT")
        .when(F.col("status") == "RUNNING", "LEASE_EXPIRED")
        .otherwise("WAITING")
    )
    return joined.withColumn("finding", finding)


def object_availability(ids: DataFrame, objects: DataFrame) -> DataFrame:
    joined = ids.join(objects.select("object_id", F.col("status").alias("_s")), "object_id", "left")
    return joined.withColumn("availability", F.when(F.col("_s").isNull(), "MISSING").when(F.col("_s") != "AVAILABLE", "NOT_AVAILABLE").otherwise("AVAILABLE")).drop("_s")


def result_conflicts(objects: DataFrame) -> DataFrame:
    """Runs with more than one available result object."""
    return objects.filter((F.col("status") == "AVAILABLE") & F.col("object_key").like("%/result/%")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def monthly_trades(details: DataFrame, month: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows of one local month: weeks that touch the month are pruned first, then each row's own month decides."""
    from tickloom.functions.scalars import week_overlaps_month
    from tickloom.operators.calendar import et_month

    return details.filter(week_overlaps_month(F.col("week_start"), F.lit(month))).filter(et_month("occurred_at") == month)


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """Batch form of request intake: CLAIMED, DUPLICATE, CONFLICT or STALE in arrival order.

    The first arrival of a message decides its hash; an arrival is stale when its aggregate has already seen an equal or
    higher sequence. Both are bucketed scans over arrival time.
    """
    from tickloom.operators.scan import Running, prefix_scan
    from tickloom.session import cut_lineage

    day = F.date_trunc("day", "arrived_at")
    first = requests.groupBy("message_id").agg(F.min(F.struct("arrived_at", "arrival", "payload_hash")).alias("_f"))
    marked = requests.join(first, "message_id").withColumn("_is_first", F.col("arrival") == F.col("_f.arrival"))
    seen = prefix_scan(
        cut_lineage(marked), ["aggregate_id"], ["arrived_at", "arrival"], day, {"_latest": Running("max", F.when(F.col("_is_first"), F.col("sequence")), exclusive=True)}
    )
    outcome = (
        F.when(~F.col("_is_first") & (F.col("payload_hash") != F.col("_f.payload_hash")), "CONFLICT")
        .when(~F.col("_is_first"), "DUPLICATE")
        .when(F.col("sequence") <= F.col("_latest"), "STALE")
        .otherwise("CLAIMED")
    )
    return seen.withColumn("outcome", outcome).drop("_f", "_is_first", "_latest")
