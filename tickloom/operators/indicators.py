"""Rolling indicators over bars.

``with_indicators`` places the bars of a series into chunks (see ``scan.in_chunks``) and adds any number of indicator
columns in one exchange. Sums and averages are differences of one running sum of decimals, so their cost does not grow
with the period and no rounding error builds up. Every indicator is NULL until it is warmed up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.scan import in_chunks, with_position

VISIBLE_BARS = 180


@dataclass(frozen=True)
class Indicator:
    """``needs``: rows of history a frame reaches back. ``build(df, w, name)`` returns the named column."""

    needs: int
    build: Callable[[DataFrame, WindowSpec], Column]


def _running(column: str, w: WindowSpec) -> Column:
    return F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _window_sum(cum: str, n: int, w: WindowSpec, offset: int = 0) -> Column:
    """Sum of the last ``n`` rows ending ``offset`` rows ago, from a running sum column."""
    end = F.lag(cum, offset).over(w) if offset else F.col(cum)
    start = F.coalesce(F.lag(cum, n + offset).over(w), F.lit(0))
    return F.when(F.col("pos") >= n + offset, end - start)


def _mean(total: Column, n: int) -> Column:
    return total.cast("double") / F.lit(float(n))


def prev_close() -> Indicator:
    return Indicator(1, lambda df, w: F.lag("close", 1).over(w))


def prev_volume() -> Indicator:
    return Indicator(1, lambda df, w: F.lag("volume", 1).over(w))


def close_sum(n: int, offset: int = 0) -> Indicator:
    """Exact sum of closes; crossings compare sums cross-multiplied by the other period instead of divided averages."""
    return Indicator(n + offset, lambda df, w: _window_sum("_cum_close", n, w, offset))


def sma(n: int, offset: int = 0) -> Indicator:
    """Mean of the last n closes, the current one included."""
    return Indicator(n + offset, lambda df, w: _mean(_window_sum("_cum_close", n, w, offset), n))


def high(n: int) -> Indicator:
    """Highest of the n closes before the current bar."""
    return Indicator(n, lambda df, w: F.when(F.col("pos") > n, F.max("close").over(w.rowsBetween(-n, -1))))


def low(n: int) -> Indicator:
    return Indicator(n, lambda df, w: F.when(F.col("pos") > n, F.min("close").over(w.rowsBetween(-n, -1))))


def volume_sum(n: int) -> Indicator:
    """Sum of the n volumes before the current bar."""
    return Indicator(n + 1, lambda df, w: _window_sum("_cum_volume", n, w, 1))


def avg_volume(n: int) -> Indicator:
    return Indicator(n + 1, lambda df, w: _mean(_window_sum("_cum_volume", n, w, 1), n))


def streak(direction: str, visible: int = VISIBLE_BARS) -> Indicator:
    """Consecutive strict rises (UP) or falls (DOWN) ending now, inside the visible window."""

    def build(df: DataFrame, w: WindowSpec) -> Column:
        moves = F.col("_change") > 0 if direction == "UP" else F.col("_change") < 0
        broken = F.max(F.when(moves, None).otherwise(F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return F.least(F.col("pos") - F.coalesce(broken, F.lit(0)), F.lit(visible - 1)).cast("int")

    return Indicator(visible, build)


def rsi(n: int = 14, flat: float = 50.0) -> Indicator:
    """Cutler RSI: simple averages over n changes. No movement gives ``flat``, no loss gives 100. Rounded to 8 places."""

    def build(df: DataFrame, w: WindowSpec) -> Column:
        gain = _window_sum("_cum_gain", n, w)
        loss = _window_sum("_cum_loss", n, w)
        value = F.bround(gain.cast("double") * 100.0 / F.nullif(gain + loss, F.lit(0)).cast("double"), 8)
        return F.when(F.col("pos") > n, F.when((gain + loss) == 0, F.lit(flat)).otherwise(value))

    return Indicator(n + 1, build)


def band_mean(n: int, offset: int = 0) -> Indicator:
    return sma(n, offset)


def band_deviation(n: int, offset: int = 0) -> Indicator:
    """Population standard deviation of the n closes ending ``offset`` bars ago."""

    def build(df: DataFrame, w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(n - 1) - offset, -offset)
        return F.when(F.col("pos") >= n + offset, F.stddev_pop(F.col("close").cast("double")).over(frame))

    return Indicator(n + offset, build)


def pct_change(base: str) -> Callable[[DataFrame], DataFrame]:
    """(close - base) * 100 / base for an existing base column, and whether it could be worked out: a zero base is an error."""
    change = F.try_divide((F.col("close") - F.col(base)).cast("double") * 100.0, F.col(base).cast("double"))
    status = F.when(F.col("close").isNull() | F.col(base).isNull(), "INPUT_MISSING").when(F.col(base) == 0, "ZERO_BASE").otherwise("OK")
    return lambda df: df.withColumns({f"pct_{base}": change, f"pct_{base}_status": status})


def series_positions(bars: DataFrame, keys: Sequence[str], bucket: str = "month") -> DataFrame:
    return bars if "pos" in bars.columns else with_position(bars, keys, ["starts_at"], F.date_trunc(bucket, "starts_at"))


def with_indicators(
    bars: DataFrame,
    keys: Sequence[str],
    indicators: dict[str, Indicator],
    bucket: str = "month",
    chunk_rows: int = 50_000,
    bounded: bool = False,
) -> DataFrame:
    """Append the named indicators to bars (columns starts_at, close, volume required).

    ``bounded=True`` declares that a series holds at most one bar per calendar slot (daily bars: some 4 000 rows in eleven
    years, 30-minute bars: some 40 000). Such a series fits one task whatever the data volume, so a single exchange by
    series serves positions and all frames. Series without that bound are cut into chunks.
    """
    halo = max(i.needs for i in indicators.values()) + 1

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        change = F.col("close") - F.lag("close", 1).over(w)
        stage = df.withColumn("_change", change)
        stage = stage.withColumns(
            {
                "_cum_close": _running("close", w),
                "_cum_volume": _running("volume", w),
                "_cum_gain": F.sum(F.greatest("_change", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                "_cum_loss": F.sum(F.greatest(-F.col("_change"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        stage = stage.withColumns({name: i.build(stage, w) for name, i in indicators.items()})
        return stage.drop("_change", "_cum_close", "_cum_volume", "_cum_gain", "_cum_loss")

    if bounded:
        series = Window.partitionBy(*keys).orderBy("starts_at")
        return compute(bars.withColumn("pos", F.row_number().over(series).cast("long")), series)
    return in_chunks(series_positions(bars, keys, bucket), keys, halo, compute, chunk_rows)


def session_open(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Opening price of the session; the window is bounded by one session of one series."""
    w = Window.partitionBy(*keys, "session_date_et").orderBy("starts_at")
    return bars.withColumn("session_open", F.first("open").over(w))


# ------------------------------------------------------------------ recursive averages


def _ema_path(x: np.ndarray, n: int) -> np.ndarray:
    """EMA seeded with the first row, along axis 0."""
    alpha = 2.0 / (n + 1)
    out = np.empty_like(x)
    out[0] = x[0]
    for i in range(1, len(x)):
        out[i] = x[i] * alpha + out[i - 1] * (1.0 - alpha)
    return out


def _paths(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    ema = _ema_path(x, fast)
    macd = ema - _ema_path(x, slow)
    return ema, macd - _ema_path(macd, signal)


def macd(
    bars: DataFrame,
    keys: Sequence[str],
    fast: int,
    slow: int,
    signal: int,
    bucket: str = "month",
    window: int = VISIBLE_BARS,
    chunk_rows: int = 50_000,
    bounded: bool = False,
) -> DataFrame:
    """``ema`` (fast), MACD histogram and its previous value, all seeded at the first bar of the visible window.

    The recursion restarts in every window, so it is a fixed linear filter over the last ``window`` closes: the response
    to each unit impulse gives the weights, and a chunk is one matrix product. Built-in windows would have to carry a
    180-element array per row. Chunks come from ``in_chunks``-style placement, so a task sees a bounded slice.
    """
    slim = bars.select(*keys, "starts_at", "close", *(["pos"] if "pos" in bars.columns else []))
    if bounded:
        series = Window.partitionBy(*keys).orderBy("starts_at")
        spread = slim.withColumn("pos", F.row_number().over(series).cast("long")).withColumns({"_home": F.lit(0), "_chunk": F.lit(0)})
    else:
        placed = series_positions(slim, keys, bucket)
        size = max(chunk_rows, window)
        home = F.floor((F.col("pos") - 1) / F.lit(size))
        tail = F.pmod(F.col("pos") - 1, F.lit(size)) >= F.lit(size - window)
        spread = placed.withColumn("_home", home).withColumn(
            "_chunk", F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
        )
    fields = {f.name: f.dataType for f in spread.schema.fields}
    out = T.StructType(
        [T.StructField(k, fields[k]) for k in keys]
        + [T.StructField("starts_at", T.TimestampType()), T.StructField("pos", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("ema", "histogram", "prev_histogram")]
    )
    ema_w, hist_w = _paths(np.eye(window), fast, slow, signal)
    weights = np.stack([ema_w[-1], hist_w[-1], hist_w[-2]], axis=1)
    needed = slow + signal + 2

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["close"].to_numpy(dtype=float)
        first = int(pdf["pos"].iloc[0])
        values = np.full((len(x), 3), np.nan)
        if first == 1:
            head = x[: window - 1]
            ema, hist = _paths(head, fast, slow, signal)
            values[: len(head), 0] = ema
            values[: len(head), 1] = hist
            values[1 : len(head), 2] = hist[:-1]
        if len(x) >= window:
            values[window - 1 :] = np.lib.stride_tricks.sliding_window_view(x, window) @ weights
        cold = pdf["pos"].to_numpy() < needed
        values[cold, 1:] = np.nan
        result = pdf[[*keys, "starts_at", "pos"]].copy()
        result[["ema", "histogram", "prev_histogram"]] = values
        return result[(pdf["_home"] == pdf["_chunk"]).to_numpy()]

    shipped = spread.select(*keys, "starts_at", F.col("close").cast("double").alias("close"), "pos", "_home", "_chunk")
    group = keys if bounded else [*keys, "_chunk"]
    done = shipped.groupBy(*group).applyInPandas(chunk, out)
    return done.select(*keys, "starts_at", "pos", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("ema", "histogram", "prev_histogram")])


# ------------------------------------------------------------------ pinned features


def feature_at(
    evaluations: DataFrame, features: DataFrame, keys: Sequence[str], at: str, period_seconds: int, out: str, bucket: str | None = "day"
) -> DataFrame:
    """Feature value of the bar that starts in ``[at - period, at)``; NULL is a data gap, older values are not used."""
    from tickloom.operators.joins import asof

    right = features.select(*keys, F.col("bar_start_at").alias("_fs"), F.col("value").alias(out))
    return asof(evaluations, right, keys, at, "_fs", [out], bucket=bucket, strict=True, tolerance_seconds=period_seconds).drop("_fs")


def lookback(operation: Column, reference: Column, period: Column, long: Column) -> Column:
    """Completed bars an operation needs."""
    suffix = F.try_element_at(F.split(reference, "_"), F.lit(-1)).try_cast("int")
    return (
        F.when(operation.isin("PRICE_COMPARE", "PRICE_CHANGE_PERCENT"),
               F.when(reference == "PREVIOUS_CLOSE", 2)
               .when(reference.startswith("SMA_"), suffix)
               .when(reference.startswith("HIGH_") | reference.startswith("LOW_"), suffix + 1)
               .otherwise(1))
        .when(operation == "VOLUME_COMPARE", F.when(reference == "PREVIOUS_VOLUME", 2).otherwise(period + 1))
        .when(operation.isin("STREAK", "BOLLINGER_REVERSAL"), period + 1)
        .when(operation == "SMA_CROSS", long + 1)
        .when(operation == "MACD_CROSS", long + period + 2)
        .otherwise(1)
    )


def visible_limit(steps: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Bars a plan has to see: 180 with MACD, else its longest lookback (at most 180)."""
    return steps.groupBy(plan).agg(
        F.when(F.bool_or(F.col("operation") == "MACD_CROSS"), VISIBLE_BARS)
        .otherwise(F.least(F.lit(VISIBLE_BARS), F.max("lookback")))
        .alias("visible_bars")
    )


