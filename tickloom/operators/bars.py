"""Bars and bar events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import plus_seconds, price, resolution_seconds
from tickloom.operators import calendar as cal
from tickloom.operators.scan import Running, in_chunks, prefix_scan, with_position


def tick_rank(ts: str, tiebreak: str) -> Column:
    """Order of ticks as one decimal: fixed-width aggregation buffers keep ``min_by``/``max_by`` on the hash path."""
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    return (micros * F.lit("10000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(tiebreak).cast("decimal(19,0)")


def _ohlcv(rows: DataFrame, keys: Sequence[str], rank: str, px: str, qty: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min_by(px, rank).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, rank).alias("close"),
        F.sum(qty).cast("long").alias("volume"),
    )


def ticks_to_bars(
    ticks: DataFrame, keys: Sequence[str], ts: str, px: Column, qty: Column, seconds: int, tiebreak: str
) -> DataFrame:
    """OHLCV bars of fixed width. Map-side aggregation keeps the shuffle at one row per (key, bar) and task."""
    width = F.lit(seconds * 1_000_000)
    start = F.timestamp_micros(F.floor(F.unix_micros(ts) / width) * width)
    rows = ticks.select(*keys, start.alias("bar_start_at"), tick_rank(ts, tiebreak).alias("_k"), px.alias("_p"), qty.alias("_q"))
    return _ohlcv(rows, [*keys, "bar_start_at"], "_k", "_p", "_q")


def day_bars(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars of already labelled ticks (columns ``k`` order, ``px``, ``l_quantity``)."""
    return _ohlcv(rows, keys, "k", "px", "l_quantity")


def session_bars(ticks: DataFrame, keys: Sequence[str], ts: str, px: Column, qty: Column, seconds: int, tiebreak: str, calendar: DataFrame) -> DataFrame:
    """Bars built from ticks inside regular hours only, stamped with the session date."""
    days = F.broadcast(
        cal.trading_sessions(calendar).select(
            F.col("session_date").alias("_d"), F.col("opens_at").alias("_o"), F.col("closes_at").alias("_c")
        )
    )
    inside = ticks.join(days, cal.et_date(ts) == F.col("_d")).filter((F.col(ts) >= F.col("_o")) & (F.col(ts) < F.col("_c")))
    bars = ticks_to_bars(inside, keys, ts, px, qty, seconds, tiebreak)
    return bars.withColumn("session_date_et", cal.et_date("bar_start_at"))


def daily_bars(ticks: DataFrame, keys: Sequence[str], ts: str, px: Column, qty: Column, tiebreak: str, calendar: DataFrame) -> DataFrame:
    """One bar per session, labelled with the official open."""
    days = F.broadcast(
        cal.trading_sessions(calendar).select(
            F.col("session_date").alias("session_date_et"), F.col("opens_at").alias("_o"), F.col("closes_at").alias("_c")
        )
    )
    rows = (
        ticks.join(days, cal.et_date(ts) == F.col("session_date_et"))
        .filter((F.col(ts) >= F.col("_o")) & (F.col(ts) < F.col("_c")))
        .select(
            *keys, "session_date_et", F.col("_o").alias("bar_start_at"), tick_rank(ts, tiebreak).alias("_k"), px.alias("_p"), qty.alias("_q")
        )
    )
    return _ohlcv(rows, [*keys, "session_date_et", "bar_start_at"], "_k", "_p", "_q")


def bar_events(bars: DataFrame, calendar: DataFrame, resolution: str, lag_seconds: int = 0) -> DataFrame:
    """Bar completion events.

    The event occurs when the bar ends (start + period, cut at the session close) and is available ``lag_seconds``
    later. A ``1d`` bar starts at the official open. A bar outside its session keeps a FALSE ``in_session`` flag.
    """
    days = F.broadcast(
        calendar.select(F.col("session_date").alias("_d"), F.col("opens_at").alias("_o"), F.col("closes_at").alias("_c"))
    )
    seconds = resolution_seconds(resolution)
    start = F.col("_o") if resolution == "1d" else F.col("bar_start_at")
    joined = bars.join(days, F.col("session_date_et") == F.col("_d"), "left")
    shaped = joined.withColumn("starts_at", start).withColumn("_full", plus_seconds("starts_at", seconds))
    return (
        shaped.withColumn("ends_at", F.least("_full", "_c"))
        .withColumn("session_truncated", F.col("ends_at") < F.col("_full"))
        .withColumn("occurred_at", F.col("ends_at"))
        .withColumn("available_at", plus_seconds("ends_at", lag_seconds))
        .withColumn("resolution", F.lit(resolution))
        .withColumn(
            "in_session",
            F.coalesce((F.col("starts_at") >= F.col("_o")) & (F.col("starts_at") < F.col("_c")), F.lit(False)),
        )
        .drop("_d", "_o", "_c", "_full")
    )


def event_id(multi_resolution: bool = False) -> Column:
    """Event identity; suffixed with the resolution when a run reads several."""
    parts = [F.col("instrument_id"), F.date_format("starts_at", "yyyyMMdd'T'HHmmss")]
    return F.concat_ws(":", *parts, *([F.col("resolution")] if multi_resolution else []))


def union_segments(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Several (resolution, bars) segments as one stream."""
    first, *rest = [df.withColumn("resolution", F.lit(res)) for res, df in frames]
    for df in rest:
        first = first.unionByName(df)
    return first


def sequence_events(events: DataFrame, run_keys: Sequence[str], seconds: Column) -> DataFrame:
    """Global order of a run's events: time, period length, instrument, id. Numbered from 1."""
    staged = events.withColumn("_period", seconds)
    return with_position(
        staged, run_keys, ["occurred_at", "_period", "instrument_id", "event_id"], F.date_trunc("day", "occurred_at"), "sequence"
    ).drop("_period")


def clip_to_run(events: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep events from the earliest warm-up start to the evaluation end of their run."""
    return events.join(bounds, list(keys)).filter(
        (F.col("occurred_at") >= F.col("warmup_start")) & (F.col("occurred_at") <= F.col("evaluation_end"))
    )


def completed_through(bars: DataFrame, as_of: Column) -> DataFrame:
    """No look-ahead: only bars that ended by ``as_of``."""
    return bars.filter(F.col("ends_at") <= as_of)


def observations(events: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals during which a series is accounted for: its bars and the closed-market intervals in their span."""
    own = events.select(*keys, "starts_at", "ends_at", F.lit("BAR").alias("source"))
    span = events.groupBy(*keys).agg(F.min("starts_at").alias("starts_at"), F.max("ends_at").alias("ends_at"))
    shut = cal.closed_intervals(calendar, span, list(keys)).withColumn("source", F.lit("CLOSED"))
    return own.unionByName(shut.select(*own.columns))


def event_ticks(events: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The ``events`` table as ticks: instrument = event type, price = value + 1, quantity = 1."""
    ticks = events.select(
        F.col("event_type").alias("instrument_id"), "ts", "event_id", (price("value") + F.lit(1).cast("decimal(1,0)")).cast("decimal(18,8)").alias("px")
    )
    return ticks, F.col("px"), F.lit(1)


def visible_at(
    events: DataFrame, decisions: DataFrame, keys: Sequence[str], available: str, order: Sequence[str], at: str, frames: Mapping[str, Column], limit: int
) -> DataFrame:
    """``decisions`` with aggregates over what a series shows at their instant: the last ``limit`` events that became available by then.

    Events count in the order they become available (``available``, then ``order``), whatever the times of their bars: a bar published
    late, or a correction, comes behind what was visible before. Each event gets the aggregates of the events up to it, and a
    decision takes those of the last one before it; NULL where nothing was visible. Both scans spread a series of any length.
    """
    axis = [available, *order]
    placed = with_position(events, keys, axis, F.date_trunc("month", available))

    def compute(df: DataFrame, window: WindowSpec) -> DataFrame:
        frame = window.rowsBetween(1 - limit, 0)
        return df.withColumns({name: value.over(frame) for name, value in frames.items()})

    shown = in_chunks(placed, keys, limit - 1, compute).select(*keys, F.col(available).alias("_at"), F.col("pos").alias("_pos"), F.struct(*frames).alias("_seen"))
    row = F.struct(*[F.col(c) for c in decisions.columns])
    asked = decisions.select(*keys, F.col(at).alias("_at"), F.lit(2**62).alias("_pos"), F.lit(None).cast(shown.schema["_seen"].dataType).alias("_seen"), row.alias("_row"))
    line = shown.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    found = prefix_scan(line, keys, ["_at", "_pos"], F.date_trunc("month", "_at"), {"_last": Running("last", F.col("_seen"))})
    return found.filter(F.col("_row").isNotNull()).select("_row.*", "_last.*")
