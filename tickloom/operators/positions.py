"""Metrics of open positions and the search for exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calendar import et_date, trading_days_between
from tickloom.operators.scan import Running, prefix_scan

PX = "decimal(18,8)"


def average_entry(basis: Column, quantity: Column) -> Column:
    return F.bround(basis.cast(PX) / quantity.cast(PX), 8).cast(PX)


def metric_percent(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator x 100 at 8 places; a zero denominator gives zero."""
    ratio = F.bround(numerator.cast(PX) * F.lit(100).cast("decimal(3,0)") / F.nullif(denominator, F.lit(0).cast(PX)).cast(PX), 8)
    return F.when(denominator == 0, F.lit(0).cast(PX)).otherwise(ratio.cast(PX))


def position_metrics(states: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, calendar: DataFrame) -> DataFrame:
    """Return, peak, drawdown and holding time of every observed bar of an open position.

    ``states``: one row per bar with cycle, opened_at, quantity_after, basis_after and close. A bar belongs to at most one
    cycle of its (run, instrument), so everything is a running value inside the cycle; no entry is paired with later bars.
    The peak starts at the average entry price of the cycle's first bar; the entry bar counts as the first held bar.
    """
    cycle = [*keys, "cycle"]
    held = states.filter("quantity_after > 0").withColumn("average_entry", average_entry(F.col("basis_after"), F.col("quantity_after")))
    opening = F.when(F.col("held_before") == 0, F.col("average_entry"))
    scanned = prefix_scan(
        held,
        cycle,
        order,
        bucket,
        {"_top": Running("max", F.col("close")), "_start": Running("max", opening), "holding_bars": Running("count", F.lit(1))},
    )
    peak = F.greatest("_start", "_top").cast(PX)
    staged = scanned.withColumn("peak_price", peak).withColumns({"_od": et_date("opened_at"), "_cd": et_date(order[0])})
    dated = trading_days_between(staged, "_od", "_cd", calendar, "holding_days")
    avg, close = F.col("average_entry"), F.col("close")
    return dated.withColumns(
        {
            "return_percent": metric_percent(close - avg, avg),
            "peak_return_percent": metric_percent(F.col("peak_price") - avg, avg),
            "drawdown_percent": metric_percent(F.col("peak_price") - close, F.col("peak_price")),
        }
    ).drop("_top", "_start", "_od", "_cd")


def exit_search(metrics: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Column, payload: Sequence[str]) -> DataFrame:
    """First bar of each cycle on which an exit rule holds; an aggregate with map-side combine."""
    hit = metrics.filter(rule)
    best = F.min(F.struct(*order, *[c for c in payload if c not in order]))
    return hit.groupBy(*keys, "cycle").agg(best.alias("_b")).select(*keys, "cycle", "_b.*")
