from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fills as X
from tickloom.operators import gates as G
from tickloom.operators import ledger as L
from tickloom.operators import rules as R
from tickloom.operators import valuation as V

KEYS = ["run_id", "instrument_id"]
ORDER = ["occurred_at", "order_id", "gross_amount"]


def _fills(spark, seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run = 1 if rng.random() < 0.6 else 2
        rows.append((run, rng.choice("AB"), dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3), i, rng.choice(["BUY", "SELL"]), rng.randrange(1, 9), rng.randrange(100, 5_000)))
    df = spark.createDataFrame(rows, "run_id int, instrument_id string, occurred_at timestamp, order_id long, side string, quantity int, gross int")
    money = "decimal(18,8)"
    shaped = df.select(
        "run_id", "instrument_id", "occurred_at", "order_id", "side", F.col("quantity").cast(money).alias("quantity"),
        (F.col("gross") / 100).cast(money).alias("gross_amount"), F.lit("0.01").cast(money).alias("fee"), *[F.lit("0.002").cast("decimal(18,8)").alias(c) for c in ("slippage", "fee_rate", "slippage_rate")],
    )
    return rows, shaped


def _by_hand(rows):
    held: dict = {}
    lots: dict = {}
    slices, executed = [], {}
    for run, inst, _, oid, side, qty, gross in rows:
        key = (run, inst)
        if side == "BUY":
            lots.setdefault(key, []).append([oid, qty])
            held[key] = held.get(key, 0) + qty
            executed[oid] = qty
            continue
        take = min(qty, held.get(key, 0))
        held[key] = held.get(key, 0) - take
        if take:
            executed[oid] = take
        while take:
            lot = lots[key][0]
            used = min(take, lot[1])
            slices.append((run, inst, oid, lot[0], used))
            lot[1] -= used
            take -= used
            if lot[1] == 0:
                lots[key].pop(0)
    return executed, slices


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_book_and_fifo_equal_a_loop(spark, seed):
    rows, df = _fills(spark, seed)
    executed, slices = _by_hand(rows)
    week = F.date_trunc("week", "occurred_at")
    booked = L.book(df, KEYS, ORDER, week)
    got = {r["order_id"]: int(r["executed"]) for r in booked.collect()}
    assert got == executed
    matched = L.fifo_match(booked, KEYS, ORDER, week, 5.0)
    pairs = sorted((r["run_id"], r["instrument_id"], r["sell"]["order_id"], r["lot"]["order_id"], int(r["consumed"])) for r in matched.collect())
    assert pairs == sorted(slices)


def test_ledger_balances_and_cash_identity(spark):
    _, df = _fills(spark, 11)
    week = F.date_trunc("week", "occurred_at")
    booked = L.book(df, KEYS, ORDER, week)
    full = L.with_basis(booked, L.realized_pnl(L.fifo_match(booked, KEYS, ORDER, week, 5.0), KEYS, ORDER), KEYS, ORDER).cache()
    ids = ["run_id", "instrument_id", "order_id"]
    entries = L.ledger_entries(full, ids)
    signed = F.when(F.col("direction") == "DEBIT", F.col("amount")).otherwise(-F.col("amount"))
    assert entries.groupBy(*ids).agg(F.sum(signed).alias("d")).filter("d <> 0").count() == 0
    cash = L.cash_after(full, ORDER, week, "1000").groupBy("run_id").agg(F.max_by("cash_after", F.struct(*ORDER)).alias("c"))
    flows = entries.filter("account = 'CASH'").groupBy("run_id").agg((F.lit(1000) + F.sum(signed)).alias("c"))
    assert {r["run_id"]: r["c"] for r in cash.collect()} == {r["run_id"]: r["c"] for r in flows.collect()}
    full.unpersist()


def test_lot_basis_is_conserved(spark):
    _, df = _fills(spark, 21)
    week = F.date_trunc("week", "occurred_at")
    booked = L.book(df, KEYS, ORDER, week)
    per_lot = L.fifo_match(booked, KEYS, ORDER, week, 5.0).groupBy("run_id", "instrument_id", "lot.order_id", "lot.gross_amount", "lot.executed").agg(
        F.sum("consumed").alias("c"), F.sum("basis").alias("b")
    )
    used_up = [r for r in per_lot.collect() if r["c"] == r["executed"]]
    assert used_up
    assert all(r["b"] == r["gross_amount"] for r in used_up)


def _life(spark, bars, **order):
    base = dt.datetime(2024, 1, 2, 15)
    rows = [(1, base + dt.timedelta(minutes=i), base + dt.timedelta(minutes=i + 1), *[str(x) for x in b]) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "order_id int, starts_at timestamp, ends_at timestamp, open string, high string, low string")
    df = df.select("order_id", "starts_at", "ends_at", *[F.col(c).cast("decimal(18,8)").alias(c) for c in ("open", "high", "low")])
    for name, value in order.items():
        df = df.withColumn(name, F.lit(value) if name in ("side", "trail_percent") else F.lit(value).cast("decimal(18,8)"))
    return df


def _hit(df):
    rows = df.collect()
    return (rows[0]["starts_at"].minute, rows[0]["base_price"]) if rows else None


def test_order_types(spark):
    bars = [(100, 101, 99), (102, 106, 101), (104, 104, 90), (95, 97, 94)]
    assert _hit(X.limit_fill(_life(spark, bars, side="BUY", limit_price="98"))) == (2, Decimal("98"))
    assert _hit(X.limit_fill(_life(spark, bars, side="SELL", limit_price="105"))) == (1, Decimal("105"))
    assert _hit(X.limit_fill(_life(spark, bars, side="BUY", limit_price="80"))) is None
    assert _hit(X.stop_fill(_life(spark, bars, side="BUY", stop_price="101.5"))) == (1, Decimal("102"))
    assert _hit(X.stop_fill(_life(spark, bars, side="SELL", stop_price="98"))) == (2, Decimal("98"))
    # triggers on bar 1 above the limit, then fills as a limit order on bar 2
    assert _hit(X.stop_limit_fill(_life(spark, bars, side="BUY", stop_price="101.5", limit_price="101"))) == (2, Decimal("101"))
    # the reference follows the highs of earlier bars: 106 less 5% on bar 2
    assert _hit(X.trailing_stop_fill(_life(spark, bars, side="SELL", reference_price="100", trail_percent="0.05"))) == (2, Decimal("100.7"))


def test_price_never_passes_the_limit(spark):
    df = spark.createDataFrame([("BUY", "100", "100.01"), ("SELL", "100", "99.99"), ("BUY", "100", None)], "side string, base string, lim string")
    price = X.execution_price(F.col("base").cast("decimal(18,8)"), F.col("side"), F.col("lim").cast("decimal(18,8)"), X.Policy())
    assert [r[0] for r in df.select(price).collect()] == [Decimal("100.01"), Decimal("99.99"), Decimal("100.05")]


@pytest.mark.parametrize("gap", [1, 3, 10])
def test_spacing_equals_greedy(spark, gap):
    rng = random.Random(gap)
    rows = [(k, x) for k in "ab" for x in range(400) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "k string, x long")
    got = sorted((r["k"], r["x"]) for r in G.spaced(df, ["k"], "x", gap, chunk=16).collect())
    expected = []
    for key in "ab":
        last = None
        for k, x in rows:
            if k == key and (last is None or x - last >= gap):
                expected.append((k, x))
                last = x
    assert got == sorted(expected)


def test_rearm_ignores_missing_input(spark):
    states = ["CANDIDATE", "INPUT_MISSING", "CANDIDATE", "CONDITION_NOT_MET", "INPUT_MISSING", "CANDIDATE", "CANDIDATE", "CONDITION_NOT_MET", "CANDIDATE"]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(states)], "k string, pos long, status string")
    got = lambda n: sorted(r["pos"] for r in G.rearmed(df, ["k"], "pos", F.floor(F.col("pos") / 2), n).collect())
    assert got(10) == [0, 5, 8]
    assert got(2) == [0, 5]


def _truth(spark, operation, arguments, columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns[n] for n in names)], ", ".join(f"{n} {t}" for n, t in ((n, _type(columns[n])) for n in names)))
    return df.select(R.RULES[operation](arguments).passed).first()[0]


def _type(value):
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "long"


@pytest.mark.parametrize(
    ("operation", "arguments", "true", "false"),
    [
        ("PRICE_COMPARE", {"operator": "GT", "column": "prev_close"}, {"close": 11.0, "prev_close": 10.0}, {"close": 10.0, "prev_close": 10.0}),
        ("PRICE_CHANGE_PERCENT", {"column": "prev_close", "direction": "DOWN", "thresholdPercent": 5}, {"close": 95.0, "prev_close": 100.0}, {"close": 95.1, "prev_close": 100.0}),
        ("VOLUME_COMPARE", {"operator": "GTE", "column": "avg", "multiplier": 2}, {"volume": 20, "avg": 10.0}, {"volume": 19, "avg": 10.0}),
        ("STREAK", {"column": "streak_up", "bars": 3}, {"pos": 4, "streak_up": 3}, {"pos": 4, "streak_up": 2}),
        ("SMA_CROSS", {"shortPeriod": 1, "longPeriod": 2, "direction": "UP"}, {"sum_1": 5, "sum_2": 8, "sum_1_prev": 3, "sum_2_prev": 6}, {"sum_1": 4, "sum_2": 8, "sum_1_prev": 3, "sum_2_prev": 6}),
        ("RSI_CROSS", {"direction": "UP", "threshold": 30}, {"rsi_previous": 30.0, "rsi_current": 30.1}, {"rsi_previous": 30.1, "rsi_current": 31.0}),
        ("MACD_CROSS", {"direction": "DOWN"}, {"prev_histogram": 0.0, "histogram": -0.1}, {"prev_histogram": -0.1, "histogram": -0.2}),
        ("POSITION_RETURN", {"direction": "LOSS", "thresholdPercent": 5}, {"return_percent": -5.0}, {"return_percent": -4.9}),
        ("HOLDING_PERIOD", {"unit": "BAR", "amount": 3}, {"holding_bars": 3}, {"holding_bars": 2}),
        ("HOLDING_PERIOD", {"unit": "SESSION_CLOSE", "amount": 1}, {"session_close": True}, {"session_close": False}),
        ("PEAK_RETURN", {"operator": "GTE", "thresholdPercent": 10}, {"peak_return_percent": 10.0}, {"peak_return_percent": 9.9}),
        ("DRAWDOWN_FROM_PEAK", {"operator": "GT", "thresholdPercent": 10}, {"drawdown_percent": 10.1}, {"drawdown_percent": 10.0}),
        ("SCHEDULE", {"cycle": "EVERY_N_TRADING_DAYS", "interval": 3}, {"new_trading_day": True, "trading_day_index": 4}, {"new_trading_day": True, "trading_day_index": 5}),
        ("COMPARE", {"column": "v", "operator": "NEQ", "threshold": 1}, {"v": 2.0}, {"v": 1.0}),
    ],
)
def test_each_rule_true_and_false(spark, operation, arguments, true, false):
    assert _truth(spark, operation, arguments, true) is True
    assert _truth(spark, operation, arguments, false) is False


def test_chain_reports_first_failure(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 1.0, 5.0), (3, 5.0, 5.0), (4, None, 5.0), (5, 5.0, None)], "id int, a double, b double")
    steps = [R.Step("COMPARE", {"column": c, "operator": "GT", "threshold": 2}) for c in "ab"]
    got = {r["id"]: r for r in R.evaluate_chain(df, steps).collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["CONDITION_NOT_MET", "CONDITION_NOT_MET", "CANDIDATE", "INPUT_MISSING", "INPUT_MISSING"]
    assert [got[i]["first_failure_step"] for i in range(1, 6)] == [2, 1, None, 1, 2]
    assert [len(got[i]["trace"]) for i in range(1, 6)] == [2, 1, 2, 1, 2]
    waiting = R.evaluate_chain(df, steps, bar_closed=F.lit(False)).first()
    assert waiting["first_failure_reason"] == "WAITING_FOR_BAR_CLOSE"


def test_position_percent_cap_stops_the_order_after_the_crossing_one(spark):
    """A cap of 100 over orders of 60: the second crosses it and passes, the third is refused; without a cap none is."""
    money = "decimal(18,8)"
    rows = [(1, "A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i, 60, 100) for i in range(4)]
    rows += [(1, "B", dt.datetime(2024, 2, 1) + dt.timedelta(days=i), 10 + i, 60, None) for i in range(4)]
    orders = spark.createDataFrame(rows, "run_id int, instrument_id string, at timestamp, order_id long, price int, cap int").select(
        "run_id", "instrument_id", "at", "order_id", F.col("price").cast(money).alias("reference_price"), F.lit(1).cast(money).alias("quantity"), F.col("cap").cast(money).alias("max_position_notional")
    )
    limits = {"cash": "100000", "strategy": "100000", "gross": "100000", "instrument": "100000"}
    found = X.exposure_flags(orders, ["at", "order_id"], F.date_trunc("week", "at"), limits, X.Policy()).collect()
    reasons = {r["order_id"]: r["reason_code"] for r in found}
    assert reasons == {i: "MAX_INSTRUMENT_POSITION_PERCENT" if i in (2, 3) else None for i in (0, 1, 2, 3, 10, 11, 12, 13)}
    empty = X.exposure_flags(orders.filter("false"), ["at", "order_id"], F.date_trunc("week", "at"), limits, X.Policy())
    assert empty.count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_basis_equals_slices(spark, seed):
    """Bounded runs are booked and matched in one piece, others over buckets; the basis of every fill is the same."""
    _, df = _fills(spark, seed)
    week = F.date_trunc("week", "occurred_at")
    booked = L.book(df, KEYS, ORDER, week)
    columns = [*KEYS, *ORDER, "executed", "held_after", "fee", "cost_basis", "realized_pnl"]
    spread = L.with_basis(booked, L.realized_pnl(L.fifo_match(booked, KEYS, ORDER, week, 5.0), KEYS, ORDER), KEYS, ORDER).select(columns)
    whole = L.with_running_basis(L.book(df, KEYS, ORDER, None, bought="bought", paid="paid"), KEYS, "bought", "paid").select(columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, spread.collect()))
    slices = [L.fifo_match(b, KEYS, ORDER, w, q, n) for b, w, q, n in ((booked, week, 5.0, None), (L.book(df, KEYS, ORDER, None, bought="bought"), None, None, "bought"))]
    assert sorted(map(str, slices[0].collect())) == sorted(map(str, slices[1].collect()))


def test_runs_above_the_limit_are_spread(spark):
    _, df = _fills(spark, 5)
    sizes = {r["run_id"]: r["count"] for r in df.groupBy("run_id").count().collect()}
    for limit in (0, min(sizes.values()), max(sizes.values())):
        seen = L.by_size(df, lambda fills, whole: fills.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.lit(whole).alias("whole")), limit)
        assert {r["run_id"]: (r["n"], r["whole"]) for r in seen.collect()} == {k: (n, n <= limit) for k, n in sizes.items()}


def test_tasks_of_whole_runs_follow_from_their_rows(spark):
    _, df = _fills(spark, 5)
    sizes = {r["run_id"]: r["count"] for r in df.groupBy("run_id").count().collect()}
    tasks = lambda fills, whole: fills.select("run_id", F.lit(whole).alias("whole"), F.lit(fills.rdd.getNumPartitions()).alias("tasks"))
    seen = {(r["run_id"], r["whole"], r["tasks"]) for r in L.by_size(df, tasks, task_rows=10, run_rows=20).collect()}
    assert seen == {(k, True, -(-(sum(sizes.values()) + 40) // 10)) for k in sizes}
    mixed = L.by_size(df, lambda fills, whole: fills.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.lit(whole).alias("whole")), min(sizes.values()), 10)
    assert {r["run_id"]: (r["n"], r["whole"]) for r in mixed.collect()} == {k: (n, n == min(sizes.values())) for k, n in sizes.items()}


@pytest.mark.parametrize(
    "name",
    [
        "metrics_documents", "equity_check", "metrics_long", "performance_metrics", "equity_curve_cost", "position_after", "equity_points", "equity_series",
        "ledger_events", "ledger_entries", "balance_check", "fifo_slices", "trade_stats", "realized_pnl", "part_manifest", "detail_keys", "run_digests",
    ],
)
def test_rows_of_bounded_runs_are_sent_once(spark, name):
    from tickloom.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "l_suppkey" in plan


@pytest.mark.parametrize(("seed", "cash"), [(1, "1000"), (2, "100000"), (3, "5")])
def test_curve_and_metrics_of_moves_equal_those_of_merged_events(spark, seed, cash):
    """Several fills share an instant here, the curve rises, falls and (from little cash) is negative."""
    _, df = _fills(spark, seed)
    fills = L.with_running_basis(L.book(df, KEYS, ORDER, None, bought="bought", paid="paid"), KEYS, "bought", "paid").cache()
    curve = V.equity_curve_cost(L.ledger_events(fills, True), cash, "week", carried=L.STATISTICS).cache()
    points = ["run_id", "as_of", "cash", "position_value", "equity"]
    moves = L.ledger_moves(fills)
    assert sorted(map(str, V.curve_of_moves(moves, cash).select(points).collect())) == sorted(map(str, curve.select(points).collect()))
    merged = V.carried_metrics(curve, V.EVENT_DRIVEN, L.STATISTICS, "month")
    direct = V.metrics_of_moves(moves, cash, L.statistics()).select(merged.columns)
    assert sorted(map(str, direct.collect())) == sorted(map(str, merged.collect()))
    assert fills.groupBy("run_id", "occurred_at").count().filter("count > 1").count() > 0


@pytest.mark.parametrize("name", ["metrics_documents", "metrics_long", "equity_points", "equity_check", "equity_series"])
def test_curves_of_bounded_runs_do_not_merge_instants_first(spark, name):
    """Fills are sorted by run and time once after the two sorts of the ledger; an aggregate over (run, instant) was between them."""
    from tickloom.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "keys=[run_id" not in plan or "occurred_at" not in plan.split("keys=[run_id")[-1].split("]")[0]
    assert plan.count(" Sort [") <= (4 if name == "equity_check" else 3)
