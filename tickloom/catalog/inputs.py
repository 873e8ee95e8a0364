"""How the given tables are read as bars, signals and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import price
from tickloom.operators import bars as B
from tickloom.operators import calendar as cal
from tickloom.operators.fills import Policy
from tickloom.sources.tables import table

POLICY = Policy()


def calendar(spark: SparkSession) -> DataFrame:
    return cal.pinned(spark)


def event_bars(spark: SparkSession, folder: str, seconds: int = 1_800) -> DataFrame:
    """Regular-hours bars of the events table; instrument = event type."""
    ticks, px, qty = B.event_ticks(table(spark, folder, "events"))
    return B.session_bars(ticks, ["instrument_id"], "ts", px, qty, seconds, "event_id", calendar(spark))


def event_bar_events(spark: SparkSession, folder: str, resolution: str = "30m", lag_seconds: int = 0) -> DataFrame:
    from tickloom.functions.scalars import resolution_seconds

    return B.bar_events(event_bars(spark, folder, resolution_seconds(resolution)), calendar(spark), resolution, lag_seconds)


def supplier_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of lineitem: instrument = supplier, price = extended price, volume = quantity."""
    lines = table(spark, folder, "lineitem")
    return B.day_bars(
        lines.select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("instrument_id"),
            F.col("l_shipdate").alias("starts_at"),
            price("l_extendedprice").alias("px"),
            F.col("l_quantity"),
            line_rank().alias("k"),
        ),
        ["instrument_id", "starts_at"],
    )


def line_rank():
    """Order of lines inside a day as one decimal, so the aggregate keeps its hash path."""
    wide = "decimal(38,0)"
    first = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast(wide)
    return (first * F.lit(10**11).cast("decimal(12,0)")).cast(wide) + F.col("l_partkey").cast("decimal(19,0)")


FILL_ORDER = ["occurred_at", "order_id", "line_no", "part_id", "gross_amount"]
FILL_KEYS = ["run_id", "instrument_id"]


def fill_log(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as a fill log: run = supplier, instrument = line number, SELL when returned."""
    lines = table(spark, folder, "lineitem")
    rates = {"fee": POLICY.rate("fee").cast("decimal(9,8)"), "slippage": POLICY.rate("slippage").cast("decimal(9,8)")}
    costs = [F.bround(price("l_extendedprice") * rate, 8).cast("decimal(18,8)").alias(name) for name, rate in rates.items()]
    return lines.select(
        F.col("l_suppkey").alias("run_id"),
        F.concat(F.lit("I"), F.col("l_linenumber").cast("string")).alias("instrument_id"),
        F.col("l_shipdate").alias("occurred_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        price("l_quantity").alias("quantity"),
        price("l_extendedprice").alias("gross_amount"),
        *costs,
        *[rate.alias(f"{name}_rate") for name, rate in rates.items()],
    )
