"""Shared capacity, causal chains, position scopes, late bars and refused sells against loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import gates as G
from tickloom.operators import ledger as L
from tickloom.operators import valuation as V
from tickloom.operators.capacity import chained, evaluated, share_capacity
from tickloom.operators import causal
from tickloom.operators.causal import causal_order

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def test_chained_lines_equal_the_steps():
    rng = random.Random(1)
    for _ in range(1500):
        pieces, steps, a = [(None, True, 0)], [], 0
        for _ in range(rng.randint(1, 12)):
            a += rng.randint(0, 6)
            steps.append((a, a + rng.randint(-1, 12), rng.randint(1, 9)))
            pieces = chained(pieces, *steps[-1])
        for f in range(0, 90):
            value = f
            for low, high, quantity in steps:
                value = max(value, min(max(value, low) + quantity, high)) if low < high else value
            assert evaluated(pieces, f) == value


def capacity_by_hand(orders, bars):
    """Bars in order; on each the open orders in the order of submission."""
    left = {o[1]: Decimal(o[2]) for o in orders}
    for instrument, start, capacity in sorted(bars, key=lambda b: b[1]):
        rest = Decimal(capacity)
        for key, ident, _, eligible, expires in orders:
            if key == instrument and eligible <= start < expires and left[ident] > 0 and rest > 0:
                taken = min(rest, left[ident])
                rest -= taken
                left[ident] -= taken
                yield key, ident, start, taken, left[ident]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 3), (2, 1024), (3, 1)])
def test_shared_capacity_equals_a_loop(spark, seed, chunk):
    """Overlapping orders of several lives, bars without volume, one instrument with nearly all orders."""
    rng = random.Random(seed)
    bars = [(i, at(m), rng.choice([0, 0, 3, 5, 8.5])) for i in "AB" for m in range(0, 600, 7)]
    orders, minute = [], 0
    for n in range(90):
        minute += rng.randint(0, 8)
        life = rng.choice([1, 10, 60, 300, 5000])
        orders.append((rng.choice("AAAAAAB"), n, rng.choice([1.0, 2.25, 6.0, 20.0]), at(minute), at(minute + life)))
    given = spark.createDataFrame(orders, "instrument_id string, order_id int, quantity double, eligible_at timestamp, expires_at timestamp").withColumn("quantity", F.col("quantity").cast("decimal(18,8)"))
    table = spark.createDataFrame([(i, t, float(c)) for i, t, c in bars], "instrument_id string, starts_at timestamp, volume double")
    found = share_capacity(given.repartition(4), table, F.col("volume"), ["eligible_at", "order_id"], F.date_trunc("hour", "eligible_at"), 10.0, chunk=chunk)
    got = sorted((r["instrument_id"], r["order_id"], r["starts_at"], r["filled_quantity"], r["remaining"]) for r in found.collect())
    assert got == sorted(capacity_by_hand(orders, bars)) and len(got) > 60
    assert {(r["remaining"] == 0) == (r["fill_status"] == "FILLED") for r in found.collect()} == {True}
    assert share_capacity(given.limit(0), table, F.col("volume"), ["eligible_at", "order_id"], F.date_trunc("hour", "eligible_at"), 10.0).count() == 0
    assert share_capacity(given, table.limit(0), F.col("volume"), ["eligible_at", "order_id"], F.date_trunc("hour", "eligible_at"), 10.0).count() == 0


@pytest.mark.parametrize("limit", [0, 40, 250_000])
def test_instruments_of_bounded_size_are_served_where_they_were_sent(spark, limit):
    """Served as a whole, spread, or both, in batches that cut instruments; the whole form sends orders and bars once."""
    rng = random.Random(5)
    bars = [(i, at(m), rng.choice([0, 3, 5, 8.5])) for i in "ABC" for m in range(0, 70 if i == "C" else 400, 7)]
    orders, minute = [], 0
    for n in range(70):
        minute += rng.randint(0, 6)
        orders.append((rng.choice("AAAAB") if n % 9 else "C", n, rng.choice([1.0, 2.25, 6.0, 20.0]), at(minute), at(minute + rng.choice([1, 10, 60, 5000]))))
    given = spark.createDataFrame(orders, "instrument_id string, order_id int, quantity double, eligible_at timestamp, expires_at timestamp").withColumn("quantity", F.col("quantity").cast("decimal(18,8)"))
    table = spark.createDataFrame([(i, t, float(c)) for i, t, c in bars], "instrument_id string, starts_at timestamp, volume double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = share_capacity(given.repartition(4), table, F.col("volume"), ["eligible_at", "order_id"], F.date_trunc("hour", "eligible_at"), 10.0, chunk=3, limit=limit)
        got = sorted((r["instrument_id"], r["order_id"], r["starts_at"], r["filled_quantity"], r["remaining"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(capacity_by_hand(orders, bars)) and len(got) > 60
    if limit == 250_000:
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning(instrument_id") == 1


def test_causal_order(spark):
    """A long shuffled chain, one with a gap, one with a branch, a ring, and a key whose start is missing."""
    rows = [("long", f"l{i}", i, i + 1) for i in range(200)]
    rows += [("gap", f"g{i}", i, i + 1) for i in range(30) if i != 11]
    rows += [("branch", f"b{i}", i, i + 1) for i in range(10)] + [("branch", "twin", 6, 70), ("branch", "twin2", 70, 71)]
    rows += [("ring", "first", 0, 1)] + [("ring", f"r{i}", 100 + i, 100 + (i + 1) % 7) for i in range(7)]
    rows += [("lost", "x", 5, 6), ("lost", "y", 6, 7)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "run string, id string, a int, b int").repartition(5)
    got = {(r["run"], r["id"]): (r["ordinal"], r["chain_status"]) for r in causal_order(df, ["run"], "id", [F.col("a")], [F.col("b")], [F.lit(0)]).collect()}
    assert len(got) == len(rows)
    assert all(got["long", f"l{i}"] == (i + 1, "ORDERED") for i in range(200))
    assert all(got["gap", f"g{i}"] == ((i + 1, "ORDERED") if i < 11 else (None, "BROKEN")) for i in range(30) if i != 11)
    assert all(got["branch", f"b{i}"] == ((i + 1, "ORDERED") if i < 6 else (None, "BRANCHED")) for i in range(10))
    assert got["branch", "twin"] == got["branch", "twin2"] == (None, "BRANCHED") and got["ring", "first"] == (1, "ORDERED")
    assert all(got["ring", f"r{i}"] == (None, "CYCLIC") for i in range(7)) and got["lost", "y"] == (None, "BROKEN")
    assert causal_order(df.limit(0), ["run"], "id", [F.col("a")], [F.col("b")], [F.lit(0)]).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_causal_order_follows_stretches_inside_blocks(spark, monkeypatch, bits):
    """Chains that cross blocks, rings inside and across them, a record that found nothing; what is stored grows with the records."""
    rows = [(k, f"{k}{i}", i, i + 1) for k in "ab" for i in range(60 if k == "a" else 400)] + [("a", "end", None, 5000)]
    rows += [("r", f"r{i}", i, (i + 1) % 40) for i in range(40)] + [("s", f"s{i}", 9 + i, 9 + (i + 1) % 3) for i in range(3)] + [("r", "one", 77, 77)]
    df = spark.createDataFrame(rows, "run string, id string, a int, b int").coalesce(1)
    stored = []
    monkeypatch.setattr(causal, "BLOCK_BITS", bits, raising=False)
    keep = causal.cut_lineage
    monkeypatch.setattr(causal, "cut_lineage", lambda table: (stored.append(table.count()), keep(table))[1])
    got = {(r["run"], r["id"]): (r["ordinal"], r["chain_status"]) for r in causal_order(df, ["run"], "id", [F.col("a")], [F.col("b")], [F.lit(0)]).collect()}
    assert len(got) == len(rows) and got["a", "end"] == (None, "BROKEN") and got["r", "one"] == (None, "CYCLIC")
    assert all(got[k, f"{k}{i}"] == (i + 1, "ORDERED") for k, n in (("a", 60), ("b", 400)) for i in range(n))
    assert all(got["s", f"s{i}"] == (None, "CYCLIC") for i in range(3))
    assert got["r", "r0"] == (1, "ORDERED") and got["r", "r39"] == (40, "ORDERED")
    assert bits < 16 or sum(stored) <= 3 * len(rows)


def test_gates_begin_anew_with_every_position_cycle(spark):
    rng = random.Random(5)
    changes = [("A", at(m), rng.choice([1, 1, 2])) for m in sorted(rng.sample(range(0, 3000, 5), 40))]
    asked = [("A" if rng.random() < 0.9 else "B", i, at(m)) for i, m in enumerate(sorted(rng.choices(range(3000), k=400)))]
    df = spark.createDataFrame(asked, "k string, id int, t timestamp")
    moved = spark.createDataFrame(changes, "k string, at timestamp, changes int")
    scoped = G.position_scopes(df, moved, ["k"], "t", F.date_trunc("hour", "at")).cache()
    expected = {i: sum(n for key, when, n in changes if key == k and when <= t) for k, i, t in asked}
    assert {r["id"]: r["scope"] for r in scoped.collect()} == expected
    spaced = G.spaced(scoped.withColumn("x", F.col("id")), ["k", "scope"], "x", 4, chunk=16)
    by, hits = defaultdict(lambda: -9), set()
    for k, i, _ in asked:
        if i - by[k, expected[i]] >= 4:
            by[k, expected[i]] = i
            hits.add(i)
    assert {r["id"] for r in spaced.collect()} == hits
    scoped.unpersist()


def test_late_bars_and_corrections(spark):
    rng = random.Random(7)
    events = [("A", i, at(10 * i), at(10 * i + rng.choice([1, 2, 30, 200, 900])), float(rng.randrange(50))) for i in range(300)]
    events += [("A", 1000 + i, e[2], at(10 * i + 2000), e[4] + 1) for i, e in enumerate(events[:80])]
    decisions = [("A", at(m)) for m in range(0, 4000, 37)] + [("B", at(5))]
    df = spark.createDataFrame(events, "k string, id int, starts_at timestamp, available_at timestamp, v double")
    asked = spark.createDataFrame(decisions, "k string, t timestamp")
    frames = {"n": F.count(F.lit(1)), "oldest": F.min("starts_at"), "total": F.sum("v")}
    got = {(r["k"], r["t"]): (r["n"], r["oldest"], r["total"]) for r in B.visible_at(df, asked, ["k"], "available_at", ["id"], "t", frames, 40).collect()}
    for k, t in decisions:
        seen = [e for e in sorted(events, key=lambda e: (e[3], e[1])) if e[0] == k and e[3] <= t][-40:]
        assert got[k, t] == ((len(seen), min(e[2] for e in seen), sum(e[4] for e in seen)) if seen else (None, None, None))


def test_no_sell_vanishes(spark):
    money = "decimal(18,8)"
    rows = [("SELL", 5), ("BUY", 4), ("SELL", 3), ("SELL", 3), ("SELL", 2), ("BUY", 1)]
    df = spark.createDataFrame([(1, "A", at(i), i, s, q) for i, (s, q) in enumerate(rows)], "run_id int, instrument_id string, occurred_at timestamp, order_id int, side string, quantity int")
    df = df.select("run_id", "instrument_id", "occurred_at", "order_id", "side", F.col("quantity").cast(money), *[F.lit("1.5").cast(money).alias(c) for c in ("gross_amount", "fee", "slippage", "fee_rate", "slippage_rate")])
    args = (["run_id", "instrument_id"], ["occurred_at", "order_id"], F.date_trunc("day", "occurred_at"))
    done = L.sell_outcomes(L.book(df, *args, refused=True)).filter("side = 'SELL'").orderBy("order_id").collect()
    assert [(int(r["executed"]), int(r["refused"]), r["outcome"], r["reason_code"]) for r in done] == [
        (0, 5, "REJECTED", "POSITION_UNAVAILABLE"), (3, 0, "FILLED", None), (1, 2, "CUT", "POSITION_UNAVAILABLE"), (0, 2, "REJECTED", "POSITION_UNAVAILABLE"),
    ]
    assert L.book(df, *args).count() == 4


def test_daily_metrics_of_a_known_curve(spark):
    """Returns of 1 %, -0.5 % and 2 % a day: Sharpe ratio and volatility by hand."""
    values = ["100", "101", "100.495", "102.5049"]
    curve = spark.createDataFrame([(1, (DAY + dt.timedelta(days=i)).date(), v) for i, v in enumerate(values)], "run_id int, day date, equity string").withColumn("equity", F.col("equity").cast("decimal(24,8)"))
    row = V.curve_metrics(curve, V.DAILY, "day", "month").first()
    returns = [0.01, -0.005, 0.02]
    mean = sum(returns) / 3
    deviation = (sum((r - mean) ** 2 for r in returns) / 2) ** 0.5
    assert row["sharpe"] == pytest.approx(mean / deviation * 252**0.5, abs=1e-6)
    assert row["annualizedVolatilityPct"] == pytest.approx(deviation * 252**0.5 * 100, abs=1e-6)
    assert row["maxDrawdownPct"] == pytest.approx(-0.5) and row["valuationPointCount"] == 4
    flat = V.curve_metrics(curve.withColumn("equity", F.lit("5").cast("decimal(24,8)")), V.DAILY, "day", "month").first()
    assert flat["sharpe"] is None and flat["annualizedVolatilityPct"] == 0


def test_daily_grid_is_never_broadcast(spark):
    """The points of a daily curve come from one row per run that Spark takes for few; at 6 000 runs they are 15 million rows."""
    rows = [(1, "A", at(0), 1, 5), (1, "A", at(2000), 2, 3), (2, "A", at(3000), 3, 4)]
    booked = spark.createDataFrame(rows, "run_id int, instrument_id string, occurred_at timestamp, order_id int, held int")
    booked = booked.select("*", F.lit("BUY").alias("side"), F.col("held").cast("decimal(18,8)").alias("held_after"), *[F.lit(1).cast("decimal(18,8)").alias(c) for c in ("gross_amount", "fee")])
    marks = booked.select("instrument_id", F.to_date("occurred_at").alias("day"), F.lit(2).cast("decimal(18,8)").alias("mark")).distinct()
    curve = V.daily_curve(booked, ["occurred_at", "order_id"], marks, "10")
    joins = [line for line in curve._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_month" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert sorted((r["run_id"], int(r["equity"])) for r in curve.collect()) == [(1, 10 - 4 + 6), (1, 10 - 4 + 6), (1, 10 - 2 + 10), (2, 10 - 2 + 8)]


def _daily_case(spark, seed):
    """Booked fills of three runs and of no run, and marks that miss days, instruments and prices; some amounts leave 64 bits."""
    rng, px = random.Random(seed), "decimal(18,8)"
    rows = []
    for i in range(160):
        gross = rng.choice(["7", "1234.56789012", "9000000000.5"])
        when = DAY + dt.timedelta(days=rng.randrange(40), minutes=i) if i % 17 else None
        rows.append((rng.choice([1, 1, 2, 3, None]), rng.choice(["A", "A", "B", "C", None]), when, i, rng.choice(["BUY", "BUY", "SELL"]), rng.choice(["1", "3", "0.33333333"]), gross, "0.25"))
    fills = spark.createDataFrame(rows, "run_id int, instrument_id string, occurred_at timestamp, order_id int, side string, quantity string, gross_amount string, fee string")
    fills = fills.select("run_id", "instrument_id", "occurred_at", "order_id", "side", *[F.col(c).cast(px).alias(c) for c in ("quantity", "gross_amount", "fee")], *[F.lit("0.002").cast(px).alias(f"{c}_rate") for c in ("fee",)])
    booked = L.book(fills, ["run_id", "instrument_id"], ["occurred_at", "order_id"], None)
    days = booked.select(F.to_date("occurred_at").alias("day")).distinct()
    prices = [(k, d, f"{rng.randrange(1, 10**9)}.{rng.randrange(10**8):08d}" if rng.random() < 0.95 else None) for k, skipped in (("A", 0.1), ("B", 0.6)) for d in [r["day"] for r in days.collect()] if rng.random() > skipped]
    present = {d for _, d, _ in prices}
    prices += [("Z", r["day"], "1") for r in days.collect() if r["day"] not in present]
    return booked, spark.createDataFrame(prices, "instrument_id string, day date, mark string").withColumn("mark", F.col("mark").cast(px))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_daily_curve_of_bounded_runs_equals_the_spread_one(spark, seed):
    booked, marks = _daily_case(spark, seed)
    fills = spark.createDataFrame(booked.collect(), booked.schema)
    args = (["occurred_at", "order_id"], marks, "1000")
    spread = V.daily_curve(fills, *args).select("run_id", "day", "equity")
    direct = V.daily_curve_of_runs(fills.repartition(3, "run_id"), *args)
    assert direct.schema == spread.schema
    rows = [sorted(map(str, curve.collect())) for curve in (direct, spread)]
    assert rows[0] == rows[1] and len(rows[0]) > 90
    assert sum("equity=None" in r for r in rows[0]) > 0 and sum("run_id=None" in r for r in rows[0]) > 20


def test_a_position_in_whole_units_is_exact(spark):
    """Quantities and marks whose product needs more digits than a double has, and sums that 64 bits do not hold."""
    px = "decimal(18,8)"
    rows = [(1, f"I{i}", at(0), i, "BUY", 33_333, "0", 33_333) for i in range(9)]
    booked = spark.createDataFrame(rows, "run_id int, instrument_id string, occurred_at timestamp, order_id int, side string, executed int, gross string, held int")
    booked = booked.select("run_id", "instrument_id", "occurred_at", "order_id", "side", F.col("gross").cast(px).alias("gross_amount"), F.lit(0).cast(px).alias("fee"), F.col("held").cast(px).alias("held_after"))
    marks = spark.createDataFrame([(f"I{i}", DAY.date(), "1000000.00000001") for i in range(9)], "instrument_id string, day date, mark string").withColumn("mark", F.col("mark").cast(px))
    row = V.daily_curve_of_runs(booked.repartition(2, "run_id"), ["occurred_at", "order_id"], marks, "1").first()
    assert row["equity"] == 1 + 9 * 33_333 * Decimal("1000000.00000001") and row["equity"] * 10**8 > 2**64
    assert V.few_marks(marks, 9) and not V.few_marks(marks, 8)


def test_daily_metrics_of_bounded_runs_are_sent_once(spark, monkeypatch):
    from tickloom.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    direct = QUERIES["daily_metrics"](spark, folder)
    plan = direct._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run_id") == 1 and "SortMergeJoin" not in plan
    monkeypatch.setattr(V, "few_marks", lambda marks: False)
    spread = QUERIES["daily_metrics"](spark, folder)
    assert sorted(map(str, direct.collect())) == sorted(map(str, spread.collect()))


def test_output_numbers_round_in_binary_as_the_sql(spark):
    import duckdb

    from tickloom.catalog.base import num

    values = [8.0485835, 2.0410915, 1.0000005, -1.0000005, 0.5, 1e12 + 0.25, -0.0000004]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(num("v")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_curve_at_cost_is_closed(spark):
    events = spark.createDataFrame([(1, at(0), "-5", "4"), (1, at(9), "2", "-1"), (2, at(9), "1", "0")], "run_id int, as_of timestamp, c string, b string")
    events = events.select("run_id", "as_of", F.col("c").cast("decimal(24,8)").alias("cash_delta"), F.col("b").cast("decimal(24,8)").alias("basis_delta"))
    curve = V.equity_curve_cost(events, "10", "day", F.lit(at(20)))
    points = sorted((r["run_id"], r["as_of"], int(r["cash"]), int(r["position_value"])) for r in curve.collect())
    assert [p for p in points if p[1] == at(20)] == [(1, at(20), 7, 3), (2, at(20), 11, 0)] and len(points) == 3 + 2 + 2
    assert V.equity_curve_cost(events, "10", "day", F.lit(at(9))).count() == 5


def test_booked_quantities_spare_fifo_its_own_scan(spark):
    """Slices from the bought quantity of the booking equal those of a scan, over bucket borders and cut sells."""
    rng = random.Random(6)
    rows = [("A" if rng.random() < 0.8 else "B", at(700 * i), i, rng.choice(["BUY", "BUY", "SELL"]), rng.randint(1, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "instrument_id string, occurred_at timestamp, order_id int, side string, q int")
    df = df.select(F.lit(1).alias("run_id"), "instrument_id", "occurred_at", "order_id", "side", F.col("q").cast("decimal(18,8)").alias("quantity"), (F.col("q") * 7).cast("decimal(18,8)").alias("gross_amount"))
    keys, order, day = ["run_id", "instrument_id"], ["occurred_at", "order_id"], F.date_trunc("day", "occurred_at")
    booked = L.book(df, keys, order, day, bought="bought").cache()
    slim, scanned = (sorted(map(str, L.fifo_match(booked, keys, order, day, 10.0, b).collect())) for b in ("bought", None))
    assert slim == scanned and len(slim) > 30
