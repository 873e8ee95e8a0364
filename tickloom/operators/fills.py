"""Orders and fills over bars.

These are open-loop table operators: an order is sized from its run's initial capital and filled from the bars of its
life. Fills do not feed back into later sizing, reservations or rules; caps are reported as flags. Policy values
(slippage, fee, participation, buffer) are columns or parameters, never constants inside the operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import floor_ratio
from tickloom.operators.joins import next_bar
from tickloom.operators.scan import Running, prefix_scan

RATE = "decimal(9,8)"
PX = "decimal(18,8)"


@dataclass(frozen=True)
class Policy:
    """Published execution policy values as decimal text."""

    slippage: str = "0.0005"
    fee: str = "0.002"
    participation: str = "0.1"
    buffer: str = "0.0001"

    def rate(self, name: str) -> Column:
        return F.lit(getattr(self, name)).cast(RATE)


def _r(value: Column) -> Column:
    return F.bround(value, 8).cast(PX)


def execution_price(base: Column, side: Column, limit: Column | None, policy: Policy) -> Column:
    """Base price moved by slippage against the order, never through its limit."""
    slip = _r(base * policy.rate("slippage"))
    slipped = F.when(side == "BUY", base + slip).otherwise(base - slip).cast(PX)
    if limit is None:
        return slipped
    guarded = F.when(side == "BUY", F.least(slipped, limit)).otherwise(F.greatest(slipped, limit))
    return F.when(limit.isNull(), slipped).otherwise(guarded)


def fill_amounts(df: DataFrame, policy: Policy, px: str = "price", base: str = "base_price", qty: str = "quantity") -> DataFrame:
    """gross = price x quantity, fee = gross x rate, slippage = |price - base| x quantity; each rounded once."""
    return (
        df.withColumn("gross_amount", F.bround(F.col(px) * F.col(qty), 8).cast("decimal(24,8)"))
        .withColumn("fee", F.bround(F.col("gross_amount") * policy.rate("fee"), 8).cast("decimal(24,8)"))
        .withColumn("slippage_amount", F.bround(F.abs(F.col(px) - F.col(base)).cast(PX) * F.col(qty), 8).cast("decimal(24,8)"))
    )


def market_fill(orders: DataFrame, bars: DataFrame, policy: Policy, bucket: str | None = "day") -> DataFrame:
    """Fill at the open of the first eligible bar; the fill happens when that bar ends."""
    found = next_bar(orders, bars, ["starts_at", "ends_at", "open", "volume"], bucket=bucket).filter(F.col("starts_at").isNotNull())
    priced = found.withColumn("base_price", F.col("open").cast(PX)).withColumn("filled_at", F.col("ends_at"))
    return priced.withColumn("price", execution_price(F.col("base_price"), F.col("side"), None, policy))


def limit_base(side: Column, limit: Column) -> Column:
    """NULL where the bar does not reach the limit."""
    buy = F.when(F.col("low") <= limit, F.least(F.col("open"), limit))
    sell = F.when(F.col("high") >= limit, F.greatest(F.col("open"), limit))
    return F.when(side == "BUY", buy).otherwise(sell)


def stop_base(side: Column, stop: Column) -> Column:
    buy = F.when(F.col("open") >= stop, F.col("open")).when(F.col("high") >= stop, stop)
    sell = F.when(F.col("open") <= stop, F.col("open")).when(F.col("low") <= stop, stop)
    return F.when(side == "BUY", buy).otherwise(sell)


def _first_hit(rows: DataFrame, base: Column, keep: Sequence[str]) -> DataFrame:
    """The earliest bar of each order on which ``base`` is not NULL (an aggregate with map-side combine)."""
    hits = rows.withColumn("_b", base).filter(F.col("_b").isNotNull())
    best = hits.groupBy("order_id").agg(F.min(F.struct("starts_at", "ends_at", "_b", *keep)).alias("_h"))
    return best.select(
        "order_id", F.col("_h.starts_at").alias("starts_at"), F.col("_h.ends_at").alias("filled_at"), F.col("_h._b").cast(PX).alias("base_price"),
        *[F.col(f"_h.{c}").alias(c) for c in keep],
    )


def limit_fill(life: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``life`` holds (order, bar) rows of ``joins.bars_in_life`` with side and limit_price."""
    return _first_hit(life, limit_base(F.col("side"), F.col("limit_price")), keep)


def stop_fill(life: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _first_hit(life, stop_base(F.col("side"), F.col("stop_price")), keep)


def stop_limit_fill(life: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """On the trigger bar only the trigger price counts, and only within the limit; later bars follow the limit rule.

    The window is per order: bounded by the bars of one order's life.
    """
    w = Window.partitionBy("order_id")
    trigger = stop_base(F.col("side"), F.col("stop_price"))
    marked = life.withColumn("_t", trigger).withColumn("_at", F.min(F.when(F.col("_t").isNotNull(), F.col("starts_at"))).over(w))
    respects = F.when(F.col("side") == "BUY", F.col("_t") <= F.col("limit_price")).otherwise(F.col("_t") >= F.col("limit_price"))
    base = F.when((F.col("starts_at") == F.col("_at")) & respects, F.col("_t")).when(
        F.col("starts_at") > F.col("_at"), limit_base(F.col("side"), F.col("limit_price"))
    )
    return _first_hit(marked, base, keep)


def trailing_stop_fill(life: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The stop trails the best price of the earlier bars: a running extreme per order, then the first breach."""
    w = Window.partitionBy("order_id").orderBy("starts_at").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.col("trail_percent").cast(RATE)
    best_sell = F.greatest(F.col("reference_price"), F.max("high").over(w)).cast(PX)
    best_buy = F.least(F.col("reference_price"), F.min("low").over(w)).cast(PX)
    marked = life.withColumn("_ref", F.when(F.col("side") == "SELL", best_sell).otherwise(best_buy))
    offset = _r(F.col("_ref") * rate)
    stop = F.when(F.col("side") == "SELL", F.col("_ref") - offset).otherwise(F.col("_ref") + offset).cast(PX)
    return _first_hit(marked.withColumn("_stop", stop), stop_base(F.col("side"), F.col("_stop")), keep)


def buying_power(cash: Column, policy: Policy) -> Column:
    return F.bround(cash - F.bround(cash * policy.rate("buffer"), 8), 8).cast("decimal(24,8)")


def size_orders(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Quantity per candidate; zero means DECLINED.

    BUY: buying power of the run's capital x budget cap x 1/n x order percent, divided by the unit cash cost and rounded
    down to the quantum. SELL: held quantity x order percent.
    """
    budget = F.bround(buying_power(F.col("capital"), policy).cast(PX) * (F.col("budget_cap_bps").cast("decimal(9,0)") / F.lit(10_000).cast("decimal(5,0)")).cast(RATE), 8).cast(PX)
    share = _r(budget * F.col("order_percent").cast("decimal(5,2)") / (F.col("alloc_den") * 100).cast("decimal(9,0)"))
    unit = (F.col("reference_price") + _r(F.col("reference_price") * policy.rate("slippage"))).cast(PX)
    unit_cash = (unit + _r(unit * policy.rate("fee"))).cast(PX)
    held_part = (F.col("held") * F.col("order_percent").cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(28,12)")
    fine = F.when(F.col("side") == "SELL", floor_ratio(held_part, F.lit(1).cast(PX))).otherwise(floor_ratio(share, unit_cash))
    quantity = F.greatest(F.when(F.col("fractional"), fine).otherwise(F.floor(fine).cast(PX)), F.lit(0).cast(PX))
    return candidates.withColumn("quantity", quantity).withColumn("sizing_status", F.when(F.col("quantity") > 0, "SIZED").otherwise("DECLINED"))


def bar_capacity(policy: Policy) -> Column:
    """What a bar's volume lets orders take, rounded down to eight places."""
    return F.bround(F.floor(F.col("volume") * policy.rate("participation") * F.lit(100_000_000)) / F.lit(100_000_000), 8).cast(PX)


def allocate_capacity(orders: DataFrame, policy: Policy, submission: Sequence[str], bucket: Column) -> DataFrame:
    """Orders share a bar's capacity (volume x participation, rounded down) in submission order.

    ``orders`` carry the bar they meet (instrument_id, starts_at, volume). The running quantity is a bucketed scan, so a
    bar that very many orders meet is split over submission buckets.
    """
    before = prefix_scan(orders, ["instrument_id", "starts_at"], submission, bucket, {"_upto": Running("sum", F.col("quantity"))})
    capacity = bar_capacity(policy)
    left = capacity - (F.col("_upto") - F.col("quantity"))
    granted = F.greatest(F.least(F.col("quantity"), left.cast(PX)), F.lit(0).cast(PX))
    return before.withColumn("capacity", capacity).withColumn("filled_quantity", granted).drop("_upto")


def fill_over_bars(life: DataFrame, policy: Policy) -> DataFrame:
    """Partial fills: an order takes each bar's capacity until it is complete.

    Exact while an instrument has one open order at a time (``capacity.share_capacity`` has no such limit). The window is per order
    (bars of one life).
    """
    w = Window.partitionBy("order_id").orderBy("starts_at")
    capacity = bar_capacity(policy)
    reached = life.withColumn("_cap", capacity).withColumn("_cum", F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    done = F.least(F.col("_cum"), F.col("quantity"))
    before = F.least(F.col("_cum") - F.col("_cap"), F.col("quantity"))
    filled = reached.withColumn("filled_quantity", (done - before).cast(PX)).withColumn("remaining", (F.col("quantity") - done).cast(PX))
    return filled.filter("filled_quantity > 0").withColumn(
        "fill_status", F.when(F.col("remaining") == 0, "FILLED").otherwise("PARTIALLY_FILLED")
    ).drop("_cap", "_cum")


def order_expiry(submitted: Column, tif: Column, day_end: Column, given: Column, horizon_days: int) -> Column:
    return (
        F.when(tif == "DAY", day_end)
        .when(tif == "GTC", F.timestamp_micros(F.unix_micros(submitted) + F.lit(horizon_days * 86_400_000_000)))
        .otherwise(given)
    )


def expired_orders(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Orders that no fill completed, with the reason of their time in force."""
    reason = F.when(F.col("tif") == "DAY", "DAY_EXPIRED").when(F.col("tif") == "GTC", "GTC_HORIZON_EXPIRED").otherwise("GTD_EXPIRED")
    return orders.join(fills.select("order_id").distinct(), "order_id", "left_anti").withColumn("reason_code", reason)


def eligibility(orders: DataFrame, horizon_days: int) -> DataFrame:
    """First broken rule in fixed order; NULL means eligible. Needs ``fractional_enabled`` from the instrument table."""
    whole = F.col("quantity_mode") == "WHOLE_SHARES"
    late = F.unix_micros("expires_at") > F.unix_micros("submitted_at") + F.lit(horizon_days * 86_400_000_000)
    reason = (
        F.when(whole & (F.col("quantity") != F.floor("quantity")), "WHOLE_SHARES_REQUIRE_INTEGER_QUANTITY")
        .when(~whole & ~F.coalesce("fractional_enabled", F.lit(False)), "FRACTIONAL_INSTRUMENT_NOT_ENABLED")
        .when((F.col("quantity_mode") == "NOTIONAL_AMOUNT") & (F.col("side") != "BUY"), "NOTIONAL_REQUIRES_LONG_EXPOSURE")
        .when(~whole & ((F.col("order_type") != "MARKET") | (F.col("tif") != "DAY")), "FRACTIONAL_REQUIRES_MARKET_DAY")
        .when(late, "ORDER_HORIZON_EXCEEDED")
    )
    return orders.withColumn("reason_code", reason)


def exposure_flags(orders: DataFrame, order: Sequence[str], bucket: Column, limits: dict[str, str], policy: Policy) -> DataFrame:
    """First cap that running commitments break: position percent, cash, strategy, gross, instrument. Flags, not feedback.

    Two bucketed scans: commitments per run, and per run and instrument. An order with a ``max_position_notional`` (optional column, the
    run's capital times the order's percent, NULL for none) is refused once what its instrument was committed to before reaches it: the
    order that crosses the cap still passes, the next one does not.
    """
    notional = F.bround(F.col("reference_price") * F.col("quantity"), 8).cast(PX)
    staged = orders.withColumn("notional", notional)
    staged = staged.withColumn("cash_needed", (F.col("notional") + _r(F.col("notional") * policy.rate("fee"))).cast(PX))
    per_run = prefix_scan(
        staged, ["run_id"], order, bucket, {"run_notional": Running("sum", F.col("notional")), "run_cash": Running("sum", F.col("cash_needed"))}
    )
    both = prefix_scan(per_run, ["run_id", "instrument_id"], order, bucket, {"instrument_notional": Running("sum", F.col("notional"))})
    cap = lambda name: F.lit(limits[name]).cast("decimal(24,8)")
    before = (F.col("instrument_notional") - F.col("notional")).cast("decimal(38,8)")
    full = before >= F.col("max_position_notional") if "max_position_notional" in orders.columns else F.lit(False)
    reason = (
        F.when(full, "MAX_INSTRUMENT_POSITION_PERCENT")
        .when(F.col("run_cash") > buying_power(cap("cash"), policy), "INSUFFICIENT_AVAILABLE_CASH")
        .when(F.col("run_cash") > cap("strategy"), "STRATEGY_BUDGET_EXCEEDED")
        .when(F.col("run_notional") > cap("gross"), "GROSS_EXPOSURE_EXCEEDED")
        .when(F.col("instrument_notional") > cap("instrument"), "INSTRUMENT_EXPOSURE_EXCEEDED")
    )
    return both.withColumn("reason_code", reason)


def notional_quantity(df: DataFrame, policy: Policy, fractional: bool = True) -> DataFrame:
    """Quantity an amount buys at the execution price, rounded down; complete once the rest buys less than one quantum."""
    fine = floor_ratio(F.col("notional"), F.col("price"))
    quantity = fine if fractional else F.floor(fine).cast(PX)
    rest = (F.col("notional") - F.bround(quantity * F.col("price"), 8)).cast("decimal(24,8)")
    return df.withColumn("quantity", quantity).withColumn("unspent", rest)
