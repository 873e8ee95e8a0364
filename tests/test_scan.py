from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.scan import Running, in_chunks, prefix_scan, running_sum_and_floor, with_position


def _rows(seed: int, n: int = 300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # one key holds a third of all rows
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(5)}"
        rows.append((key, rng.randrange(200), i, rng.choice([None, rng.randrange(-50, 50)])))
    return rows


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("width", [1, 17, 1000])
def test_prefix_scan_equals_one_pass(spark, reverse, width):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    outs = {
        "s": Running("sum", F.col("v")),
        "c": Running("count", F.col("v")),
        "hi": Running("max", F.col("v"), exclusive=True),
        "lo": Running("min", F.col("v")),
        "last": Running("last", F.col("v"), exclusive=True),
        "prev": Running("prev", F.col("v")),
        "next": Running("prev", F.col("v"), reverse=True),
    }
    got = {r["id"]: r for r in prefix_scan(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), outs, reverse=reverse).collect()}
    frame = pd.DataFrame(rows, columns=["k", "t", "id", "v"]).astype({"v": object})
    for _, group in frame.groupby("k"):
        ordered = group.sort_values(["t", "id"], ascending=not reverse)
        seen: list = []
        items = [(int(i), None if pd.isna(v) else int(v)) for i, v in zip(ordered["id"], ordered["v"], strict=True)]
        for at, (ident, v) in enumerate(items):
            before = [x for x in seen if x is not None]
            upto = before + ([v] if v is not None else [])
            row = got[ident]
            assert row["s"] == (sum(upto) if upto else None)
            assert row["c"] == len(upto)
            assert row["hi"] == (max(before) if before else None)
            assert row["lo"] == (min(upto) if upto else None)
            assert row["last"] == (before[-1] if before else None)
            assert row["prev"] == (seen[-1] if seen else None)
            assert row["next"] == (items[at + 1][1] if at + 1 < len(items) else None)
            seen.append(v)


def test_sum_keeps_all_decimal_places(spark):
    rows = [("a", i, "0.00000001") for i in range(50)] + [("a", 50, "99999999.99999999")]
    df = spark.createDataFrame(rows, "k string, t long, v string").withColumn("v", F.col("v").cast("decimal(24,8)"))
    out = prefix_scan(df, ["k"], ["t"], F.floor(F.col("t") / 7), {"s": Running("sum", F.col("v"))})
    assert str(out.filter("t = 50").first()["s"]) == "100000000.00000049"


def test_running_sum_and_floor(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.5 else "b", i, rng.randrange(-9, 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumn("v", F.col("v").cast("decimal(18,8)"))
    out = running_sum_and_floor(df, ["k"], ["t"], F.floor(F.col("t") / 13), F.col("v"), "s", "m")
    got = {(r["k"], r["t"]): (int(r["s"]), int(r["m"]), r["m_before"]) for r in out.collect()}
    for key in "ab":
        total, low = 0, None
        for k, t, v in rows:
            if k != key:
                continue
            before, total = low, total + v
            low = total if low is None else min(low, total)
            assert got[(k, t)] == (total, low, before)


@pytest.mark.parametrize("chunk", [5, 64, 10_000])
def test_chunks_give_exact_frames(spark, chunk):
    rows = [("hot", i, (i * 37) % 101) for i in range(257)] + [("x", i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    placed = with_position(df, ["k"], ["t"], F.floor(F.col("t") / 50))
    out = in_chunks(placed, ["k"], 4, lambda d, w: d.withColumn("m", F.max("v").over(w.rowsBetween(-4, -1))), chunk_rows=chunk)
    got = {(r["k"], r["t"]): r["m"] for r in out.collect()}
    assert len(got) == len(rows)
    for key, t, _ in rows:
        window = [v for k, i, v in rows if k == key and t - 4 <= i < t]
        assert got[(key, t)] == (max(window) if window else None)
