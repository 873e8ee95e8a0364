"""Checks. Each returns the violating rows (or findings); an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import plus_seconds
from tickloom.operators.calendar import et_date, et_week, trading_sessions
from tickloom.operators.scan import Running, prefix_scan, with_position


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Missing fields, wrong types, and NULLs in required fields (one aggregate over all columns)."""
    spark: SparkSession = df.sparkSession
    have = {f.name: f.dataType for f in df.schema.fields}
    static = [(f.name, "MISSING", 0) for f in schema.fields if f.name not in have]
    static += [(f.name, "TYPE", 0) for f in schema.fields if f.name in have and have[f.name] != f.dataType]
    findings = spark.createDataFrame(static, "column_name string, finding string, n bigint")
    required = [f.name for f in schema.fields if not f.nullable and f.name in have]
    if not required:
        return findings
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    nulls = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit("NULL_VALUES").alias("finding"), F.col(c).alias("n")) for c in required])).alias("x"))
    return findings.unionByName(nulls.select("x.*").filter("n > 0"))


def check_row_counts(rows: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    actual = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    joined = declared.join(actual, list(keys), "full")
    return joined.select(*keys, F.col("row_count").alias("declared"), "actual").filter(~F.col("declared").eqNullSafe(F.col("actual")))


def check_order_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_session_date(bars: DataFrame, ts: str, session_date: str) -> DataFrame:
    return bars.filter(et_date(ts) != F.col(session_date))


def check_period(bars: DataFrame, objects: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    joined = bars.join(objects.select(*keys, "period_start", "period_end"), list(keys))
    return joined.filter((F.col(ts) < F.col("period_start")) | (F.col(ts) >= F.col("period_end")))


def check_ohlc(bars: DataFrame) -> DataFrame:
    bad = (
        (F.least("open", "high", "low", "close") <= 0)
        | (F.col("volume") < 0)
        | (F.col("high") < F.greatest("open", "close"))
        | (F.col("low") > F.least("open", "close"))
        | (F.col("low") > F.col("high"))
    )
    return bars.filter(bad)


def check_span(bars: DataFrame, seconds: int) -> DataFrame:
    full = plus_seconds("starts_at", seconds)
    shorter = (F.col("ends_at") < full) & F.col("session_truncated")
    return bars.filter((F.col("ends_at") != full) & ~shorter)


def check_strictly_increasing(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, bucket: Column) -> DataFrame:
    scanned = prefix_scan(df, keys, [ts, tiebreak], bucket, {"previous": Running("prev", F.col(ts))})
    return scanned.filter(F.col("previous") >= F.col(ts))


def check_segments(segments: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Neighbouring segments must touch: OVERLAP or GAP otherwise."""
    scanned = prefix_scan(segments, keys, ["starts_at", "ends_at"], bucket, {"_before": Running("prev", F.col("ends_at"))})
    finding = F.when(F.col("starts_at") < F.col("_before"), "OVERLAP").when(F.col("starts_at") > F.col("_before"), "GAP")
    return scanned.withColumn("finding", finding).filter(F.col("finding").isNotNull()).drop("_before")


def check_shard_complete(objects: DataFrame, keys: Sequence[str], shards: int) -> DataFrame:
    """Exactly one part per shard: MISSING or DUPLICATE otherwise."""
    wanted = objects.select(*keys).distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    have = objects.groupBy(*keys, F.col("shard").cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("_n"))
    finding = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_n") > 1, "DUPLICATE")
    return wanted.join(have, [*keys, "shard"], "left").withColumn("finding", finding).filter(F.col("finding").isNotNull()).drop("_n")


def check_sessions_covered(cover: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions that intersect ``[window_start, window_end)`` of a key but are not inside its coverage.

    The calendar is bounded, so each key meets it through a broadcast equi-join on the month.
    """
    days = trading_sessions(calendar).select("session_date", "opens_at", "closes_at", F.date_trunc("month", "opens_at").alias("_m"))
    spread = cover.withColumn(
        "_m", F.explode(F.sequence(F.date_trunc("month", "window_start"), F.date_trunc("month", "window_end"), F.expr("INTERVAL 1 MONTH")))
    )
    joined = spread.join(F.broadcast(days), "_m").filter((F.col("opens_at") < F.col("window_end")) & (F.col("closes_at") > F.col("window_start")))
    return joined.filter((F.col("opens_at") < F.col("covered_from")) | (F.col("closes_at") > F.col("covered_through"))).select(*keys, "session_date")


def readable_manifests(manifests: DataFrame, policies: DataFrame, schema_id: str) -> DataFrame:
    """First reason a manifest cannot be read for a policy; NULL when it can."""
    joined = manifests.join(policies, "policy_id")
    overlap = (F.col("period_start") < F.col("policy_end")) & (F.col("policy_start") < F.col("period_end"))
    reason = F.when(F.col("status") != "AVAILABLE", "NOT_AVAILABLE").when(F.col("schema_id") != schema_id, "SCHEMA_MISMATCH").when(~overlap, "PERIOD_OUTSIDE_POLICY")
    return joined.withColumn("reason_code", reason)


def check_events(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Findings per event: DUPLICATE_ID, AVAILABLE_BEFORE_OCCURRED, DUPLICATE_POSITION, OUTSIDE_SESSION (first in this order)."""
    ids = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("_ids"))
    slots = events.groupBy("available_at", "source_sequence").agg(F.count(F.lit(1)).alias("_slots"))
    days = F.broadcast(calendar.select(F.col("session_date").alias("_d"), F.col("opens_at").alias("_o"), F.col("closes_at").alias("_c")))
    joined = events.join(ids, "event_id").join(slots, ["available_at", "source_sequence"]).join(days, et_date("occurred_at") == F.col("_d"), "left")
    inside = (F.col("occurred_at") >= F.col("_o")) & (
        (F.col("occurred_at") < F.col("_c")) | ((F.col("event_type") == "BAR_CLOSED") & (F.col("occurred_at") == F.col("_c")))
    )
    finding = (
        F.when(F.col("_ids") > 1, "DUPLICATE_ID")
        .when(F.col("available_at") < F.col("occurred_at"), "AVAILABLE_BEFORE_OCCURRED")
        .when(F.col("_slots") > 1, "DUPLICATE_POSITION")
        .when(~F.coalesce(inside, F.lit(False)), "OUTSIDE_SESSION")
    )
    return joined.withColumn("finding", finding).filter(F.col("finding").isNotNull()).select(*events.columns, "finding")


PIN_CHECKS = (
    ("status", "NOT_SUCCEEDED"),
    ("definition", "DEFINITION_MISMATCH"),
    ("version", "VERSION_MISMATCH"),
    ("resolution", "RESOLUTION_MISMATCH"),
    ("result_hash", "RESULT_HASH_MISMATCH"),
)


def check_feature_pins(required: DataFrame, materialised: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First mismatch between a pin and its materialisation; NULL when everything matches."""
    right = materialised.select(*keys, *[F.col(c).alias(f"_m_{c}") for c, _ in PIN_CHECKS], F.col("period_start").alias("_ps"), F.col("period_end").alias("_pe"))
    joined = required.join(right, list(keys), "left")
    reason = F.when(F.col("_m_status").isNull(), "MATERIALISATION_MISSING")
    for column, code in PIN_CHECKS:
        expected = F.lit("SUCCEEDED") if column == "status" else F.col(column)
        reason = reason.when(~F.col(f"_m_{column}").eqNullSafe(expected), code)
    reason = reason.when((F.col("_ps") > F.col("window_start")) | (F.col("_pe") < F.col("window_end")), "WINDOW_NOT_COVERED")
    return joined.select(*required.columns, reason.alias("reason_code"))


def check_parts(parts: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Part numbers 1..N without gap and without overlap in time."""
    numbered = prefix_scan(
        parts, keys, ["part"], bucket, {"_rn": Running("count", F.lit(1)), "_end": Running("prev", F.col("period_end"))}
    )
    finding = F.when(F.col("_rn") != F.col("part"), "NUMBERING").when(F.col("_end") > F.col("period_start"), "OVERLAP")
    return numbered.withColumn("finding", finding).filter(F.col("finding").isNotNull()).drop("_rn", "_end")


def check_detail_rows(rows: DataFrame, parts: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows in the wrong week, wrong bounds or wrong count of a part (first in this order)."""
    actual = rows.groupBy(*keys).agg(
        F.count_if(et_week(ts) != F.col("week_start")).alias("_wrong"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    joined = parts.join(actual, list(keys), "full")
    finding = (
        F.when(F.col("_n").isNull() | F.col("row_count").isNull(), "UNMATCHED_PART")
        .when(F.col("_wrong") > 0, "WRONG_WEEK")
        .when((F.col("_lo") != F.col("period_start")) | (F.col("_hi") != F.col("period_end")), "PERIOD_BOUNDS")
        .when(F.col("_n") != F.col("row_count"), "ROW_COUNT")
    )
    return joined.select(*keys, finding.alias("finding")).filter("finding IS NOT NULL")


def check_balanced(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transactions with fewer than two entries or unequal sides."""
    signed = F.when(F.col("direction") == "DEBIT", F.col("amount")).otherwise(-F.col("amount"))
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.sum(signed).alias("imbalance")).filter("entries < 2 OR imbalance <> 0")


def check_fill_arithmetic(fills: DataFrame) -> DataFrame:
    gross = F.bround(F.col("price") * F.col("quantity"), 8)
    slip = F.bround(F.abs(F.col("price") - F.col("base_price")).cast("decimal(18,8)") * F.col("quantity"), 8)
    return fills.filter((F.col("gross_amount") != gross) | (F.col("slippage_amount") != slip))


def check_position_deltas(fills: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Each fill must move its position by exactly its quantity."""
    scanned = prefix_scan(fills, keys, order, bucket, {"_held": Running("prev", F.col("held_after"))})
    moved = F.col("held_after") - F.coalesce("_held", F.lit(0))
    expected = F.when(F.col("side") == "BUY", F.col("executed")).otherwise(-F.col("executed"))
    return scanned.filter(moved != expected).drop("_held")


def check_month_ids(trades: DataFrame, listed: DataFrame) -> DataFrame:
    """Record ids present on one side only, per run and month."""
    a = trades.select("run_id", "et_month", "record_id", F.lit(1).alias("_a")).distinct()
    b = listed.select("run_id", "et_month", "record_id", F.lit(1).alias("_b")).distinct()
    finding = F.when(F.col("_a").isNull(), "ONLY_LISTED").when(F.col("_b").isNull(), "ONLY_STORED")
    return a.join(b, ["run_id", "et_month", "record_id"], "full").withColumn("finding", finding).filter("finding IS NOT NULL").drop("_a", "_b")


def check_metric_set(metrics: DataFrame, catalogue: Sequence[tuple[str, str]]) -> DataFrame:
    """Missing and unknown metric keys per run, and COUNT metrics with a fractional value.

    ``catalogue`` is the fixed list of (key, unit).
    """
    entries = F.array(*[F.struct(F.lit(k).alias("metric_key"), F.lit(u).alias("_unit")) for k, u in catalogue])
    wanted = metrics.select("run_id").distinct().select("run_id", F.inline(entries))
    joined = wanted.join(metrics.select("run_id", "metric_key", "value", F.lit(1).alias("_m")), ["run_id", "metric_key"], "full")
    finding = (
        F.when(F.col("_m").isNull(), "MISSING").when(F.col("_unit").isNull(), "UNKNOWN").when((F.col("_unit") == "COUNT") & (F.col("value") != F.floor("value")), "NOT_INTEGRAL")
    )
    return joined.select("run_id", "metric_key", finding.alias("finding")).filter("finding IS NOT NULL")


def check_equity(curve: DataFrame, order: str, bucket: Column | None) -> DataFrame:
    """Strictly increasing instants, equity = cash + positions, never negative."""
    scanned = prefix_scan(curve, ["run_id"], [order], bucket, {"_before": Running("prev", F.col(order))})
    finding = (
        F.when(F.col("_before") >= F.col(order), "ORDER").when(F.col("equity") != F.col("cash") + F.col("position_value"), "SUM").when(F.col("equity") < 0, "NEGATIVE")
    )
    return scanned.withColumn("finding", finding).filter("finding IS NOT NULL").drop("_before")


def check_summary_counters(monthly: DataFrame) -> DataFrame:
    names = ("evaluation_count", "active_branch_count", "trade_event_count", "data_gap_count", "triggered_count", "rejected_count")
    negative = F.least(*names) < 0
    return monthly.filter(negative | (F.col("rejected_count") > F.col("trade_event_count")) | (F.col("data_gap_count") + F.col("triggered_count") > F.col("evaluation_count")))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    return with_position(df, keys, order, bucket, "ordinal")
