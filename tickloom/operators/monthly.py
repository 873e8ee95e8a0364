"""Monthly judgment: why strategies did or did not trade, per local calendar month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import canonical_json, sha256, uuid5
from tickloom.operators.calendar import et_month
from tickloom.operators.digests import run_digest
from tickloom.operators.scan import with_position

COUNTERS = ("evaluation_count", "active_branch_count", "trade_event_count", "data_gap_count", "triggered_count", "rejected_count")


def monthly_counters(evaluations: DataFrame, records: DataFrame) -> DataFrame:
    """Six independent counters per run and month; two partial aggregates and one join of the small results."""
    keys = ["run_id", "et_month"]
    a = evaluations.groupBy("run_id", et_month("evaluated_at").alias("et_month")).agg(
        F.count(F.lit(1)).alias("evaluation_count"),
        F.sum("active_branches").alias("active_branch_count"),
        F.count_if("data_gap").alias("data_gap_count"),
        F.count_if("trade_occurred").alias("triggered_count"),
    )
    b = records.groupBy("run_id", et_month("occurred_at").alias("et_month")).agg(
        F.count(F.lit(1)).alias("trade_event_count"), F.count_if(F.col("kind") == "REJECTION").alias("rejected_count")
    )
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def first_failures(outcomes: DataFrame) -> DataFrame:
    """First failing condition per non-triggered evaluation; PRO per active branch, BASIC in one scope.

    ``outcomes``: evaluation_id, run_id, evaluated_at, mode, scope_id, active, trade_occurred, ordinal, condition_id, passed.
    """
    failed = outcomes.filter(~F.col("trade_occurred") & F.col("active") & ~F.col("passed"))
    return failed.groupBy("run_id", "evaluation_id", "evaluated_at", "mode", "scope_id").agg(
        F.min(F.struct("ordinal", "condition_id")).alias("_f")
    ).select("run_id", "evaluation_id", "evaluated_at", "mode", "scope_id", F.col("_f.condition_id").alias("condition_id"))


def failure_histogram(failures: DataFrame) -> DataFrame:
    return failures.groupBy("run_id", et_month("evaluated_at").alias("et_month"), "mode", "scope_id", "condition_id").agg(
        F.count(F.lit(1)).alias("occurrence_count")
    )


def monthly_trade_ids(records: DataFrame) -> DataFrame:
    """Record ids of each run and month in (time, id) order, in long form with an ordinal.

    Long form on purpose: one month of a hot run may hold any number of records and must not become one array.
    """
    staged = records.withColumn("et_month", et_month("occurred_at"))
    return with_position(staged, ["run_id", "et_month"], ["occurred_at", "record_id"], F.date_trunc("day", "occurred_at"), "ordinal").select(
        "run_id", "et_month", "ordinal", "record_id"
    )


def summary_documents(counters: DataFrame, histogram: DataFrame, trade_ids: DataFrame) -> DataFrame:
    """Canonical JSON per run and month with its hash and content-addressed id.

    The failure counts of a month are one entry per condition of the strategy (bounded by its plan); the trade ids enter as
    the digest of their list.
    """
    keys = ["run_id", "et_month"]
    counts = histogram.groupBy(*keys).agg(
        F.to_json(
            F.array_sort(F.collect_list(F.struct("mode", "scope_id", "condition_id", "occurrence_count")))
        ).alias("failure_counts")
    )
    ids = run_digest(trade_ids, keys, ["ordinal", "record_id"]).withColumnRenamed("digest", "trade_record_digest")
    joined = counters.join(counts, keys, "left").join(ids, keys, "left")
    fields = {"run_id": "run_id", "et_month": "et_month", "failure_counts": F.coalesce("failure_counts", F.lit("[]")), "trade_record_digest": "trade_record_digest"}
    document = canonical_json({**fields, **{c: c for c in COUNTERS}})
    return joined.select(*keys, document.alias("document")).withColumns(
        {"summary_hash": sha256("document"), "summary_id": uuid5(F.concat(F.lit("monthly:"), sha256("document")))}
    )


def verify_documents(documents: DataFrame) -> DataFrame:
    """Documents whose text no longer matches the stored hash."""
    return documents.filter(sha256("document") != F.col("summary_hash"))


def total_counters(counters: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return counters.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])
