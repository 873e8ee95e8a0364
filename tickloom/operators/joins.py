"""Time-series joins: as-of in both directions, first bar of an order, range joins, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.calendar import session_status
from tickloom.operators.scan import Running, prefix_scan


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    bucket: str | None = "month",
    strict: bool = False,
    tolerance_seconds: int | None = None,
    forward: bool = False,
    right_tiebreak: str | None = None,
) -> DataFrame:
    """Attach to each left row the nearest right row of the same key at or before it (after it with ``forward``).

    ``strict`` excludes equal times; ``tolerance_seconds`` turns an older match into NULL (a gap, no stale fallback).
    Both sides are merged into one ordered stream and resolved by a bucketed scan, so the cost is linear and a key that
    holds a large share of the rows is spread over its time buckets (``bucket=None`` for keys bounded by definition).
    """
    # At equal times the side that must not be seen sorts later in scan direction.
    right_rank, left_rank = (1, 0) if strict != forward else (0, 1)
    tie = F.col(right_tiebreak).cast("long") if right_tiebreak else F.lit(None).cast("long")
    fields = list(dict.fromkeys([right_ts, *payload]))
    a = left.select(
        *keys,
        F.col(left_ts).alias("_t"),
        F.lit(left_rank).alias("_side"),
        F.lit(None).cast("long").alias("_tie"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).alias("_right"),
    )
    b = right.select(
        *keys,
        F.col(right_ts).alias("_t"),
        F.lit(right_rank).alias("_side"),
        tie.alias("_tie"),
        F.lit(None).alias("_left"),
        F.struct(*fields).alias("_right"),
    )
    merged = a.unionByName(b)
    label = F.date_trunc(bucket, F.col("_t")) if bucket else None
    scanned = prefix_scan(
        merged, keys, ["_t", "_side", "_tie"], label, {"_hit": Running("last", F.col("_right"))}, reverse=forward
    ).filter(F.col("_left").isNotNull())
    hit = F.col("_hit")
    if tolerance_seconds is not None:
        gap = F.abs(F.unix_micros(F.col("_t")) - F.unix_micros(hit[right_ts]))
        hit = F.when(gap <= tolerance_seconds * 1_000_000, hit)
    staged = scanned.select("_left", hit.alias("_hit"))
    taken = set(left.columns)
    return staged.select("_left.*", *[F.col("_hit")[f].alias(f if f not in taken else f"right_{f}") for f in fields])


def next_bar(orders: DataFrame, bars: DataFrame, payload: Sequence[str], bucket: str | None = "month") -> DataFrame:
    """The first bar of the instrument starting in ``[eligible_at, expires_at)``; NULL when there is none."""
    found = asof(orders, bars, ["instrument_id"], "eligible_at", "starts_at", payload, bucket=bucket, forward=True)
    live = F.col("starts_at") < F.col("expires_at")
    return found.select(*orders.columns, *[F.when(live, F.col(c)).alias(c) for c in dict.fromkeys(["starts_at", *payload])])


def bars_in_life(orders: DataFrame, bars: DataFrame, order_zone_date: Column, last_date: Column, bar_date: str) -> DataFrame:
    """Every bar inside an order's life, as an equi-join on (instrument, session date).

    An order is repeated once per date of its life, which the order horizon bounds; it never meets bars outside it.
    """
    spread = orders.withColumn("_day", F.explode(F.sequence(order_zone_date, last_date)))
    right = bars.withColumn("_day", F.col(bar_date))
    return spread.join(right, ["instrument_id", "_day"]).filter(
        (F.col("starts_at") >= F.col("eligible_at")) & (F.col("starts_at") < F.col("expires_at"))
    ).drop("_day")


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], unit: str = "day") -> DataFrame:
    """Intersections of half-open intervals ``(starts_at, ends_at)``.

    Both sides are spread over the calendar units they touch and joined on (keys, unit). A pair is kept only in the unit
    that holds the start of its intersection, so it appears once.
    """

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        last = F.timestamp_micros(F.unix_micros(F.col(end)) - 1)
        step = F.expr(f"INTERVAL 1 {unit.upper()}")
        return df.filter(F.col(start) < F.col(end)).withColumn(
            "_unit", F.explode(F.sequence(F.date_trunc(unit, F.col(start)), F.date_trunc(unit, last), step))
        )

    left = spread(a, "starts_at", "ends_at")
    right = spread(b.withColumnRenamed("starts_at", "_bs").withColumnRenamed("ends_at", "_be"), "_bs", "_be")
    begin = F.greatest(F.col("starts_at"), F.col("_bs"))
    joined = left.join(right, [*keys, "_unit"]).filter(
        (F.col("starts_at") < F.col("_be")) & (F.col("_bs") < F.col("ends_at")) & (F.date_trunc(unit, begin) == F.col("_unit"))
    )
    return (
        joined.withColumn("overlap_start", begin)
        .withColumn("overlap_end", F.least("ends_at", "_be"))
        .drop("_unit", "_bs", "_be")
    )


def outside(df: DataFrame, ts: str, skips: DataFrame, keys: Sequence[str], unit: str = "day") -> DataFrame:
    """Rows whose instant lies in no skip interval of the same keys (anti range join on keys and calendar unit)."""
    last = F.timestamp_micros(F.unix_micros("ends_at") - 1)
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    spread = skips.filter("starts_at < ends_at").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("starts_at").alias("_s"),
        F.col("ends_at").alias("_e"),
        F.explode(F.sequence(F.date_trunc(unit, "starts_at"), F.date_trunc(unit, last), step)).alias("_unit"),
    )
    condition = (F.date_trunc(unit, F.col(ts)) == F.col("_unit")) & (F.col(ts) >= F.col("_s")) & (F.col(ts) < F.col("_e"))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_k_{k}"))
    return df.join(spread, condition, "left_anti")


# The stages that a skip interval may block.
STAGES = ("EVALUATION", "ORDER_TRIGGER", "FILL")


def stage_allowed(df: DataFrame, ts: str, stage: str, skips: DataFrame, keys: Sequence[str], calendar: DataFrame, unit: str = "day") -> DataFrame:
    """Rows whose instant permits a stage: no skip interval of the same keys blocks it, and a fill also needs the regular session.

    ``skips`` may have ``stages`` (the stages an interval blocks); without the column, or where it is NULL, it blocks all. The session test
    is a filter over the broadcast calendar and comes first, so that only instants of open sessions meet the skips.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    if stage == "FILL":
        df = session_status(df, ts, calendar, "_status").filter("_status = 'REGULAR_OPEN'").drop("_status")
    if "stages" in skips.columns:
        skips = skips.filter(F.col("stages").isNull() | F.array_contains("stages", stage))
    return outside(df, ts, skips, keys, unit)


def reconcile(required: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer comparison of key sets: MISSING, EXTRA, DUPLICATE or OK per key."""
    want = required.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want"))
    have = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    finding = (
        F.when(F.col("_have").isNull(), "MISSING")
        .when(F.col("_want").isNull(), "EXTRA")
        .when(F.col("_have") > 1, "DUPLICATE")
        .otherwise("OK")
    )
    return want.join(have, list(keys), "full").select(*keys, finding.alias("finding"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Top-1 per key by ``order``, as an aggregate with map-side combine (no sort of the group)."""
    best = F.max(F.struct(*order, *[c for c in payload if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def nest_children(parents: DataFrame, children: DataFrame, keys: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Attach the sorted array of child structs. For children bounded per parent (positions of one record)."""
    nested = children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))
    return parents.join(nested, list(keys), "left")


def bind_rules(rules: DataFrame, bars: DataFrame, resolution: str = "resolution") -> DataFrame:
    """Every rule meets every bar of its instrument and resolution.

    The rules table grows with the number of strategies, so there is no broadcast hint: Spark broadcasts it where its measured
    size allows.
    """
    return bars.join(rules, ["instrument_id", resolution])


def corrections(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts whose content changed: ADDED, REMOVED or CORRECTED (with the superseded hash). Equal content: no row."""
    a = old.select(*keys, F.col("content_hash").alias("supersedes"))
    b = new.select(*keys, F.col("content_hash").alias("content_hash"))
    change = (
        F.when(F.col("supersedes").isNull(), "ADDED").when(F.col("content_hash").isNull(), "REMOVED").otherwise("CORRECTED")
    )
    return (
        a.join(b, list(keys), "full")
        .filter(~F.col("supersedes").eqNullSafe(F.col("content_hash")))
        .withColumn("change", change)
    )
