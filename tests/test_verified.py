"""Verified scans, observers and hash trees of detail parts."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.operators import detail as D
from tickloom.sources import verified as W

DAY = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
SCHEMA = pa.schema([("bar_start_at", pa.timestamp("us", tz="UTC")), ("value", pa.decimal128(38, 8))], metadata={"schema_version": "v1"})
COLUMNS = "bar_start_at:timestamp[us, tz=UTC],value:decimal128(38, 8)"


def at(minute):
    return DAY + dt.timedelta(minutes=minute)


def _object(path, minutes, schema=SCHEMA, **more):
    table = pa.table({"bar_start_at": [at(m) for m in minutes], "value": [m for m in minutes]}, schema=pa.schema([schema.field(0), pa.field("value", pa.int64())]))
    pq.write_table(table.cast(schema), path, **more)
    return str(path)


def test_objects_that_differ_from_their_manifest(spark, tmp_path):
    good = _object(tmp_path / "good.parquet", range(10))
    old = _object(tmp_path / "old.parquet", range(5), use_deprecated_int96_timestamps=True)
    late = _object(tmp_path / "late.parquet", range(30, 45), row_group_size=4)
    empty = _object(tmp_path / "empty.parquet", [])
    other = _object(tmp_path / "other.parquet", range(3), schema=pa.schema([SCHEMA.field(0), pa.field("value", pa.float64())], metadata={"schema_version": "v1"}))
    unversioned = _object(tmp_path / "unversioned.parquet", range(3), schema=pa.schema(list(SCHEMA)))
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"PAR1 nothing here PAR1")
    rows = [
        (good, 10, at(0), at(10)), (good.replace("good", "gone"), 1, at(0), at(1)), (str(broken), 1, at(0), at(1)), (late, 15, at(30), at(44)), (empty, 0, at(0), at(1)),
        (other, 3, at(0), at(3)), (unversioned, 3, at(0), at(3)), (f"file://{late}", 14, at(30), at(60)),
    ]
    objects = spark.createDataFrame(rows, "path string, row_count long, period_start timestamp, period_end timestamp")
    found = W.footers(objects, "bar_start_at")
    got = {(r["path"], r["row_count"]): r["finding"] for r in W.verify_objects(objects, found, COLUMNS, "v1").collect()}
    assert [got[p, n] for p, n, *_ in rows] == [None, "MISSING", "UNREADABLE", "PERIOD", None, "SCHEMA", "VERSION", "ROW_COUNT"]
    facts = {r["path"]: r for r in found.collect()}
    assert facts[good]["period_end"] == at(9).replace(tzinfo=None) and facts[good]["byte_size"] > 0 and facts[empty]["row_count"] == 0
    rough = spark.createDataFrame([(old, 5, at(0), at(4))], objects.schema)
    assert [r["finding"] for r in W.verify_objects(rough, W.footers(rough, "bar_start_at")).collect()] == ["PERIOD"]


def test_refused_and_bad_objects_are_not_read(spark, tmp_path):
    good, bad = _object(tmp_path / "a.parquet", range(4)), _object(tmp_path / "b.parquet", range(9))
    objects = spark.createDataFrame([(good, None), (bad, "PERIOD")], "path string, finding string")
    schema = "bar_start_at timestamp, value decimal(38,8)"
    assert W.scan_verified(spark, objects, schema).count() == 4
    assert W.scan_verified(spark, objects.filter("finding IS NOT NULL"), schema).count() == 0
    with pytest.raises(W.ScanRefused, match="too many"):
        W.scan_verified(spark, objects, schema, [lambda o: None, lambda o: "too many" if o.count() > 1 else None])


def test_observers_count_in_the_same_pass(spark):
    df, first = W.observed(spark.range(1000), "all", n=F.count(F.lit(1)), total=F.sum("id"))
    even, second = W.observed(df.filter("id % 2 = 0"), "even", n=F.count(F.lit(1)))
    assert even.agg(F.sum("id")).first()[0] == 249500
    assert first.get == {"n": 1000, "total": 499500} and second.get == {"n": 500}


def test_a_changed_part_changes_one_path(spark):
    rows = [(run, kind, dt.date(2024, 1, 1) + dt.timedelta(weeks=w), p, f"{run}{kind}{w}{p}", 10) for run in (1, 2) for kind in ("TRADE", "LEDGER") for w in range(3) for p in (1, 2)]
    shape = "run_id int, record_type string, week_start date, part int, identities_hash string, row_count long"
    parts = spark.createDataFrame(rows, shape)
    tree = D.bundle_tree(parts)
    after = spark.createDataFrame([(*r[:4], "new", r[5]) if r[:4] == (1, "LEDGER", dt.date(2024, 1, 8), 2) else r for r in rows], shape)
    key = lambda r: (r["run_id"], r["record_type"], r["week_start"], r["level"])
    old, new = ({key(r): r["digest"] for r in t.collect()} for t in (tree, D.bundle_tree(after)))
    assert {k for k in old if old[k] != new[k]} == {(1, "LEDGER", dt.date(2024, 1, 8), "WEEK"), (1, "LEDGER", None, "TYPE"), (1, None, None, "BUNDLE")}
    updated = D.update_bundle_tree(tree, after, spark.createDataFrame([(1, "LEDGER", dt.date(2024, 1, 8))], "run_id int, record_type string, week_start date"))
    assert {key(r): r["digest"] for r in updated.collect()} == new and len(old) == 12 + 4 + 2
    swapped = spark.createDataFrame([(*r[:3], 3 - r[3], *r[4:]) for r in rows], shape)
    assert all(new_digest != old[k] for k, new_digest in {key(r): r["digest"] for r in D.bundle_tree(swapped).collect()}.items())


def _bundle_fills(spark):
    """Fills of three runs and of no run: instants that repeat, one missing, a Monday's first instant in New York, sells at cost."""
    from tickloom.operators import ledger as L

    monday = dt.datetime(2024, 1, 8, 5)
    rows = []
    for i in range(90):
        when = monday + dt.timedelta(days=i // 4) if i % 11 else None
        rows.append((None if i % 9 == 4 else i % 3, f"I{i % 2}", when, i // 2, i % 2, 7, "SELL" if i % 4 == 3 else "BUY", 2, 10 if i % 8 else 0))
    df = spark.createDataFrame(rows, "run_id int, instrument_id string, occurred_at timestamp, order_id long, line_no int, part_id long, side string, quantity int, gross int")
    px = "decimal(18,8)"
    log = df.select(*df.columns[:7], F.col("quantity").cast(px).alias("quantity"), F.col("gross").cast(px).alias("gross_amount"), *[F.lit("0.5").cast(px).alias(c) for c in ("fee", "slippage", "fee_rate", "slippage_rate")])
    keys = ["run_id", "instrument_id"]
    booked = L.book(log, keys, ["occurred_at", "order_id", "line_no", "part_id", "gross_amount"], None, bought="bought", paid="paid")
    return L.with_running_basis(booked, keys, "bought", "paid").drop("paid")


@pytest.mark.parametrize(("part", "runs"), [(3, "run_id IS NOT NULL"), (50, "true")])
def test_bundles_of_bounded_runs_equal_those_of_numbered_rows(spark, monkeypatch, part, runs):
    """Numbering joins on the run, so that rows of no run are numbered anew each hour there: these are compared uncut."""
    from tickloom.catalog import queue_queries as C

    monkeypatch.setattr(C, "_PART", part)
    built = _bundle_fills(spark).filter(runs)
    fills = spark.createDataFrame(built.collect(), built.schema)
    spread = C._bundles(fills)
    rows = [sorted(map(str, tree.select(spread.columns).collect())) for tree in (C._bundles_of_runs(fills.repartition(3, "run_id")), spread)]
    assert rows[0] == rows[1] and len(rows[1]) > 50
    assert sum("level='BUNDLE'" in row for row in rows[1]) == 3 + (runs == "true")


def test_weeks_are_cut_into_parts(spark):
    import hashlib

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    entries = [(at(i), f"r{i}") for i in range(5)]
    week = dt.date(2024, 1, 1)
    rows = [(1, week, entries[3:], [], [], []), (1, week, entries[:3], [], None, [(None, "x")]), (1, None, [], [], [], [(None, "y")])]
    kind = "array<struct<t: timestamp, i: string>>"
    df = spark.createDataFrame(rows, f"run_id int, week_start date, {', '.join(f'{k} {kind}' for k in D.RECORD_TYPES)}")
    got = {(r["record_type"], r["week_start"], r["level"]): (r["digest"], r["row_count"]) for r in D.bundles_of_runs(df, 2).collect()}
    trade = sha("\n".join(f"{n}:{sha(text)}" for n, text in enumerate(["r0\nr1", "r2\nr3", "r4"], 1)))
    x, y = (sha(f"1:{sha(text)}") for text in "xy")
    trades, points = sha(f"2024-01-01:{trade}"), sha(f"2024-01-01:{x}")
    assert got == {
        ("TRADE", week, "WEEK"): (trade, 5), ("CALCULATION", week, "WEEK"): (x, 1), ("CALCULATION", None, "WEEK"): (y, 1), ("TRADE", None, "TYPE"): (trades, 5),
        ("CALCULATION", None, "TYPE"): (points, 2), (None, None, "BUNDLE"): (sha(f"TRADE:{trades}\nCALCULATION:{points}"), 7),
    }


def test_details_of_bounded_runs_are_sent_once(spark):
    from tickloom.catalog import QUERIES

    plan = QUERIES["detail_bundles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "l_suppkey" in plan
