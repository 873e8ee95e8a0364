"""Positions, lots, cash and the double-entry ledger from a fill log.

Fills carry an explicit order (``order`` columns). Everything is a running value per run or per (run, instrument) and
uses the bucketed scans, so one run that holds a large share of all fills is spread over its time buckets. Runs of at most
``WHOLE_RUN_ROWS`` fills need no buckets: ``by_size`` sends their rows once, and everything per run follows in the same task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import prorate, rounded_quotient, units
from tickloom.operators.scan import Running, prefix_scan, running_sum_and_floor
from tickloom.session import cut_lineage

PX = "decimal(18,8)"
#: Fills of a run that one task may order; a run with more is spread over buckets.
WHOLE_RUN_ROWS = 250_000


def by_size(
    fills: DataFrame, work: Callable[[DataFrame, bool], DataFrame], limit: int = WHOLE_RUN_ROWS, task_rows: int | None = None, run_rows: int = 0
) -> DataFrame:
    """``work(fills, whole)`` over the fills of all runs, of which each one's result depends on its own fills only.

    Runs of at most ``limit`` fills come with ``whole``, their rows partitioned by ``run_id``: groups and windows whose keys begin there
    need no further exchange. Larger runs come without it and have to be spread. There are at most rows / ``limit`` of them.

    ``task_rows`` is for work that unfolds its rows: as many tasks share the whole runs as give each that many rows, so that what a task
    sorts fits its memory at any size. A run counts as its fills and ``run_rows`` more.
    """
    sizes = fills.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    if task_rows is None:
        large, tasks = cut_lineage(sizes.filter(F.col("_n") > limit).select("run_id")), []
    else:
        sizes = cut_lineage(sizes)
        large = sizes.filter(F.col("_n") > limit).select("run_id")
        rows = sizes.filter(F.col("_n") <= limit).agg(F.sum(F.col("_n") + run_rows)).first()[0] or 0
        tasks = [max(fills.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))]
    if large.isEmpty():
        return work(fills.repartition(*tasks, "run_id"), True)
    few = F.broadcast(large)
    small = work(fills.join(few, "run_id", "left_anti").repartition(*tasks, "run_id"), True)
    return small.unionByName(work(fills.join(few, "run_id", "left_semi"), False))


def _signed() -> Column:
    return F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))


def seed_positions(fills: DataFrame, seeds: DataFrame) -> DataFrame:
    """Opening lots as BUY rows before any fill (they must sort first by the fill order)."""
    return seeds.unionByName(fills)


def book(
    fills: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, refused: bool = False, bought: str | None = None, paid: str | None = None
) -> DataFrame:
    """Cap each sell by the held quantity and add ``executed``, ``held_before``, ``held_after``.

    ``bought`` names a column for the quantity bought so far, which ``fifo_match`` then need not scan for, ``paid`` one for the gross
    amounts of these buys. Costs are optional: a fill log may leave them to be worked out from the booked amount.

    held = max(held + q, 0) has the closed form S - min(0, running minimum of S) with S the running signed quantity: one
    scan instead of a loop. Amounts of a capped sell shrink with the executed quantity, its costs by the rates of its own
    policy (columns ``fee_rate`` and ``slippage_rate``). Sells that meet no position have nothing to book and are left out, but for
    ``refused``: then they stay, with nothing executed (see ``sell_outcomes``).
    """
    zero = F.lit(0).cast(PX)
    named = {bought: "quantity", paid: "gross_amount"}
    sums = {name: F.when(F.col("side") == "BUY", F.col(c)).otherwise(zero) for name, c in named.items() if name}
    floor_now = running_sum_and_floor(fills, keys, order, bucket, _signed(), "_s", "_m", sums)
    if bought and bucket is None:
        # Matching takes it in this width, which is sorted as a plain number.
        floor_now = floor_now.withColumn(bought, F.col(bought).cast(PX))
    held_after = (F.col("_s") - F.least(F.col("_m"), zero)).cast(PX)
    held_before = (F.col("_s") - _signed() - F.least(F.coalesce("_m_before", zero), zero)).cast(PX)
    booked = floor_now.withColumns({"held_after": held_after, "held_before": held_before})
    executed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(F.least(F.col("quantity"), F.col("held_before"))).cast(PX)
    booked = booked.withColumn("executed", executed)
    booked = booked if refused else booked.filter("executed > 0")
    whole = F.col("executed") == F.col("quantity")
    unit = F.bround(F.col("gross_amount") / F.col("quantity"), 8).cast(PX)
    gross = F.when(whole, F.col("gross_amount")).otherwise(F.bround(unit * F.col("executed"), 8).cast(PX))
    booked = booked.withColumn("gross_amount", gross)
    for cost in [c for c in ("fee", "slippage") if c in fills.columns]:
        again = F.bround(F.col("gross_amount") * F.col(f"{cost}_rate"), 8).cast(PX)
        booked = booked.withColumn(cost, F.when(whole, F.col(cost)).otherwise(again))
    return booked.drop("_s", "_m", "_m_before")


def sell_outcomes(sells: DataFrame) -> DataFrame:
    """``refused`` quantity, ``outcome`` (FILLED, CUT, REJECTED) and ``reason_code`` of sells booked with ``refused``."""
    left = (F.col("quantity") - F.col("executed")).cast(PX)
    outcome = F.when(left == 0, "FILLED").when(F.col("executed") > 0, "CUT").otherwise("REJECTED")
    return sells.withColumns({"refused": left, "outcome": outcome, "reason_code": F.when(left > 0, "POSITION_UNAVAILABLE")})


def position_changes(booked: DataFrame) -> DataFrame:
    """``run_id, instrument_id, at, changes``: how often a position opened or closed at each instant."""
    opens = (F.col("side") == "BUY") & (F.col("held_before") == 0)
    closes = F.col("held_after") == 0
    changed = booked.select("run_id", "instrument_id", F.col("occurred_at").alias("at"), (opens.cast("int") + closes.cast("int")).alias("n")).filter("n > 0")
    return changed.groupBy("run_id", "instrument_id", "at").agg(F.sum("n").alias("changes"))


def fifo_match(booked: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, width: float | None, bought: str | None = None) -> DataFrame:
    """Sells consume the oldest lots: one row per (sell, lot) slice with its share of the lot's basis.

    Lots and sells both cut the axis of cumulative quantity. The cut points of both are merged into one ordered stream;
    each stretch between two neighbouring points belongs to exactly one lot and one sell, found by a scan from above. The
    output has at most lots + sells rows and no pair is formed that is not a match. ``width`` is the bucket width on the
    quantity axis. Basis by cumulative rounding: slices of a lot add up to its basis exactly. ``bought`` is the
    column that ``book`` gave under that name; ``booked`` has to be a stored table then, unless ``width`` is None, which is for bounded
    positions and scans each in one piece.
    """
    if bought:
        # Buys are executed whole, and what is not held any more has been sold.
        cut = booked.withColumns({"_bq": F.col(bought), "_sq": F.col(bought) - F.col("held_after")})
    else:
        buys = F.when(F.col("side") == "BUY", F.col("executed")).otherwise(F.lit(0).cast(PX))
        sells = F.when(F.col("side") == "SELL", F.col("executed")).otherwise(F.lit(0).cast(PX))
        cut = prefix_scan(booked, keys, order, bucket, {"_bq": Running("sum", buys), "_sq": Running("sum", sells)})
    item = F.struct(*dict.fromkeys([*order, "executed", "gross_amount"]))
    buy = F.col("side") == "BUY"
    points = cut.select(
        *keys,
        F.when(buy, F.col("_bq")).otherwise(F.col("_sq")).cast(PX).alias("q"),
        F.when(buy, 0).otherwise(1).alias("kind"),
        F.when(buy, item).alias("lot"),
        F.when(~buy, item).alias("sell"),
    )
    points = points if bought else cut_lineage(points)
    label = F.floor(F.col("q") / F.lit(width)) if width else None
    # A lot ending at q covers (q - size, q]; the owner of a stretch is the first point at or above it.
    ended = F.when(F.col("lot").isNotNull(), F.struct(F.col("q").alias("end"), F.col("lot")))
    stretches = prefix_scan(
        points,
        keys,
        ["q", "kind"],
        label,
        {
            "_lot": Running("last", ended, reverse=True),
            "_sell": Running("last", F.col("sell"), reverse=True),
            "_from": Running("prev", F.col("q")),
        },
    )
    start = F.coalesce("_from", F.lit(0).cast(PX))
    lot_start = (F.col("_lot.end") - F.col("_lot.lot.executed")).cast(PX)
    rows = stretches.withColumn("_a", start).filter(F.col("_lot").isNotNull() & F.col("_sell").isNotNull() & (F.col("q") > F.col("_a")))

    def upto(point: Column) -> Column:
        share = (point - lot_start).cast(PX)
        return prorate(F.col("_lot.lot.gross_amount"), share, F.col("_lot.lot.executed"))

    return rows.select(
        *keys,
        F.col("_sell").alias("sell"),
        F.col("_lot.lot").alias("lot"),
        (F.col("q") - F.col("_a")).cast(PX).alias("consumed"),
        (upto(F.col("q")) - upto(F.col("_a"))).cast(PX).alias("basis"),
    )


def realized_pnl(slices: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per sell: proceeds minus the consumed basis."""
    return (
        slices.select(*keys, *[F.col(f"sell.{c}").alias(c) for c in order], F.col("sell.gross_amount").alias("_g"), "basis")
        .groupBy(*keys, *order)
        .agg(F.max("_g").alias("_g"), F.sum("basis").cast(PX).alias("cost_basis"))
        .withColumn("realized_pnl", (F.col("_g") - F.col("cost_basis")).cast(PX))
        .drop("_g")
    )


def with_basis(booked: DataFrame, pnl: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fills with cost basis (BUY: gross) and realized result (BUY: zero)."""
    # gross_amount belongs to the order columns and is unchanged between both sides
    joined = booked.join(pnl, [*keys, *order], "left")
    buy = F.col("side") == "BUY"
    return joined.withColumn("cost_basis", F.when(buy, F.col("gross_amount")).otherwise(F.col("cost_basis"))).withColumn(
        "realized_pnl", F.when(buy, F.lit(0).cast(PX)).otherwise(F.col("realized_pnl"))
    )


def with_running_basis(booked: DataFrame, keys: Sequence[str], bought: str, paid: str) -> DataFrame:
    """What ``with_basis`` adds, for bounded positions and without slices or joins.

    The slices of a lot add up, so what a sell consumes is the difference of two running values: the basis of everything sold up to it,
    and up to the sell before. The former is what was paid for the lots before the one it ends in, and its share of that one.
    ``bought`` and ``paid`` are the columns that ``book`` gave under these names.
    """
    buy = F.col("side") == "BUY"
    # Where a lot and a sell end at one point, the sell ends in that lot.
    points = booked.withColumns({"_q": F.when(buy, F.col(bought)).otherwise(F.col(bought) - F.col("held_after")).cast(PX), "_kind": F.when(buy, 1).otherwise(0)})
    down = Window.partitionBy(*keys).orderBy(F.col("_q").desc(), F.col("_kind").desc())
    lot = F.when(buy, F.struct(F.col("_q").alias("end"), "executed", "gross_amount", F.col(paid).alias("paid")))
    owned = points.withColumn("_lot", F.last(lot, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    share = (F.col("_q") - (F.col("_lot.end") - F.col("_lot.executed"))).cast(PX)
    # prorate, one step a column: nothing is divided twice, and nothing for buys.
    owned = owned.withColumns({"_top": F.when(~buy, units(F.col("_lot.gross_amount")) * units(share)), "_bottom": F.when(~buy, units(F.col("_lot.executed")))})
    owned = owned.withColumns({"_quotient": F.call_function("div", F.col("_top"), F.col("_bottom")), "_rest": F.col("_top") % F.col("_bottom")})
    upto = F.col("_lot.paid") - F.col("_lot.gross_amount") + rounded_quotient(F.col("_quotient"), F.col("_rest"), F.col("_bottom"))
    owned = owned.withColumn("_sold", F.when(~buy, upto.cast("decimal(28,8)"))).drop("_top", "_bottom", "_quotient", "_rest")
    names = ", ".join(f"`{k}`" for k in keys)
    earlier = F.expr(f"lead(_sold, 1) IGNORE NULLS OVER (PARTITION BY {names} ORDER BY _q DESC, _kind DESC)")
    found = owned.withColumn("_earlier", F.coalesce(earlier, F.lit(0).cast("decimal(28,8)")))
    basis = F.when(buy, F.col("gross_amount")).otherwise((F.col("_sold") - F.col("_earlier")).cast(PX))
    done = found.withColumn("cost_basis", basis).drop("_q", "_kind", "_lot", "_sold", "_earlier")
    return done.withColumn("realized_pnl", F.when(buy, F.lit(0).cast(PX)).otherwise((F.col("gross_amount") - F.col("cost_basis")).cast(PX)))


def ledger_entries(fills: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Balanced entries per fill; zero amounts are dropped.

    BUY: SECURITY debit gross, FEE debit, CASH credit gross + fee. SELL: CASH debit gross - fee, FEE debit, SECURITY credit
    basis, REALIZED_PNL credit of a gain or debit of a loss.
    """
    return fills.select(*ids, F.explode(entry_list()).alias("_e")).select(*ids, "_e.*").filter("amount <> 0")


#: Entries that one fill can have.
MOST_ENTRIES = 4


def entry_list() -> Column:
    """The entries of a fill as a list, those of zero amounts included."""

    def entry(account: str, direction: Column | str, amount: Column) -> Column:
        d = F.lit(direction) if isinstance(direction, str) else direction
        return F.struct(F.lit(account).alias("account"), d.alias("direction"), amount.cast("decimal(24,8)").alias("amount"))

    gross, fee, basis, pnl = F.col("gross_amount"), F.col("fee"), F.col("cost_basis"), F.col("realized_pnl")
    buy = F.array(entry("SECURITY", "DEBIT", gross), entry("FEE", "DEBIT", fee), entry("CASH", "CREDIT", gross + fee))
    sell = F.array(
        entry("CASH", F.when(gross - fee >= 0, "DEBIT").otherwise("CREDIT"), F.abs(gross - fee)),
        entry("FEE", "DEBIT", fee),
        entry("SECURITY", "CREDIT", basis),
        entry("REALIZED_PNL", F.when(pnl >= 0, "CREDIT").otherwise("DEBIT"), F.abs(pnl)),
    )
    return F.when(F.col("side") == "BUY", buy).otherwise(sell)


def cash_delta() -> Column:
    return F.when(F.col("side") == "BUY", -(F.col("gross_amount") + F.col("fee"))).otherwise(F.col("gross_amount") - F.col("fee")).cast("decimal(24,8)")


def basis_delta() -> Column:
    return (F.col("cost_basis") * F.when(F.col("side") == "BUY", 1).otherwise(-1)).cast("decimal(24,8)")


def cash_after(fills: DataFrame, order: Sequence[str], bucket: Column, initial_cash: str) -> DataFrame:
    """Running cash of each run."""
    run = prefix_scan(fills.withColumn("_d", cash_delta()), ["run_id"], order, bucket, {"_c": Running("sum", F.col("_d"))})
    return run.withColumn("cash_after", (F.lit(initial_cash).cast("decimal(24,8)") + F.col("_c")).cast("decimal(24,8)")).drop("_c", "_d")


def position_after(fills: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None) -> DataFrame:
    """Running quantity and cost basis of each position."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    scanned = prefix_scan(
        fills, keys, order, bucket, {"quantity_after": Running("sum", F.col("executed") * sign), "basis_after": Running("sum", F.col("cost_basis") * sign)}
    )
    return scanned


def position_cycles(fills: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Cycle number and opening time: a cycle opens when the quantity leaves zero."""
    opens = (F.col("side") == "BUY") & (F.col("held_before") == 0)
    return prefix_scan(
        fills,
        keys,
        order,
        bucket,
        {"cycle": Running("sum", F.when(opens, 1).otherwise(0)), "opened_at": Running("last", F.when(opens, F.col("occurred_at")))},
    )


def ledger_events(fills: DataFrame, stats: bool = False) -> DataFrame:
    """Cash and basis movements merged per run and instant, and with ``stats`` the ``trade_stats`` of that instant."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    return fills.groupBy("run_id", F.col("occurred_at").alias("as_of")).agg(
        F.sum(cash_delta()).cast("decimal(24,8)").alias("cash_delta"),
        F.sum(F.col("cost_basis") * sign).cast("decimal(24,8)").alias("basis_delta"),
        *[c.alias(name) for name, c in (statistics() if stats else {}).items()],
    )


def ledger_moves(fills: DataFrame) -> DataFrame:
    """Cash and basis movement of every fill, not merged, and the columns its ``statistics`` read."""
    return fills.select("run_id", F.col("occurred_at").alias("as_of"), cash_delta().alias("cash_delta"), basis_delta().alias("basis_delta"), "side", "realized_pnl", "fee", "slippage")


def statistics() -> dict[str, Column]:
    sell = F.col("side") == "SELL"
    return {
        "fillCount": F.count(F.lit(1)),
        "closingTradeCount": F.count_if(sell),
        "winningTradeCount": F.count_if(sell & (F.col("realized_pnl") > 0)),
        "losingTradeCount": F.count_if(sell & (F.col("realized_pnl") < 0)),
        "realizedPnl": F.sum("realized_pnl"),
        "totalFees": F.sum("fee"),
        "totalSlippage": F.sum("slippage"),
    }


STATISTICS = ("fillCount", "closingTradeCount", "winningTradeCount", "losingTradeCount", "realizedPnl", "totalFees", "totalSlippage")


def trade_stats(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fills.groupBy(*keys).agg(*[c.alias(name) for name, c in statistics().items()])


RECORD_RANK = {"ORDER": 0, "FILL": 1, "CANCELLATION": 2, "REJECTION": 3}


def records(orders: DataFrame, fills: DataFrame, expiries: DataFrame, rejections: DataFrame) -> DataFrame:
    """One stream of result records; at equal times ORDER, FILL, CANCELLATION, REJECTION."""

    def part(df: DataFrame, kind: str, at: str) -> DataFrame:
        return df.select("run_id", "order_id", F.col(at).alias("occurred_at"), F.lit(kind).alias("kind"), F.lit(RECORD_RANK[kind]).alias("kind_rank"))

    return (
        part(orders, "ORDER", "submitted_at")
        .unionByName(part(fills, "FILL", "filled_at"))
        .unionByName(part(expiries, "CANCELLATION", "expires_at"))
        .unionByName(part(rejections, "REJECTION", "submitted_at"))
    )


def order_counts(result_records: DataFrame) -> DataFrame:
    return result_records.groupBy("run_id").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.count_if(F.col("kind") == "FILL").alias("fill_count"),
        F.count_if(F.col("kind") == "CANCELLATION").alias("cancellation_count"),
        F.count_if(F.col("kind") == "REJECTION").alias("rejection_count"),
    )
