from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as I

KEY = ["instrument_id"]


def _bars(spark, closes, name="x"):
    start = dt.datetime(2024, 1, 2)
    rows = [(name, start + dt.timedelta(minutes=30 * i), str(c), 100 + i) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "instrument_id string, starts_at timestamp, close string, volume long")
    return df.withColumn("close", F.col("close").cast("decimal(18,8)"))


def _path(steps):
    out = [100.0]
    for s in steps:
        out.append(out[-1] + s)
    return out


@pytest.mark.parametrize(
    ("steps", "expected"),
    [
        ([1] * 14, 100.0),
        ([-1] * 14, 0.0),
        ([0] * 14, 50.0),
        ([2] * 7 + [-1] * 7, 66.66666667),
        ([1, -2] + [0] * 12, 33.33333333),
    ],
)
def test_rsi_vectors(spark, steps, expected):
    df = I.with_indicators(_bars(spark, _path(steps)), KEY, {"rsi": I.rsi(14)})
    values = [r["rsi"] for r in df.orderBy("starts_at").collect()]
    assert values[:14] == [None] * 14
    assert values[14] == expected


def test_frames_across_chunks(spark):
    rng = random.Random(1)
    closes = [rng.randrange(10, 60) for _ in range(120)]
    wanted = {"sma": I.sma(5), "high": I.high(7), "low": I.low(7), "av": I.avg_volume(6), "up": I.streak("UP", 30), "dev": I.band_deviation(5, 1)}
    rows = I.with_indicators(_bars(spark, closes), KEY, wanted, bucket="day", chunk_rows=32).orderBy("starts_at").collect()
    streak = 0
    for i, row in enumerate(rows):
        assert row["sma"] == (sum(closes[i - 4 : i + 1]) / 5 if i >= 4 else None)
        assert row["high"] == (max(closes[i - 7 : i]) if i >= 7 else None)
        assert row["low"] == (min(closes[i - 7 : i]) if i >= 7 else None)
        assert row["av"] == (sum(100 + j for j in range(i - 6, i)) / 6 if i >= 6 else None)
        streak = streak + 1 if i and closes[i] > closes[i - 1] else 0
        assert row["up"] == streak
        if i >= 5:
            window = closes[i - 5 : i]
            mean = sum(window) / 5
            assert row["dev"] == pytest.approx((sum((x - mean) ** 2 for x in window) / 5) ** 0.5)


def test_macd_restarts_in_every_window(spark):
    rng = random.Random(5)
    closes = [round(rng.uniform(50, 80), 2) for _ in range(300)]

    def ema(xs, n):
        a, out = 2 / (n + 1), [xs[0]]
        for x in xs[1:]:
            out.append(x * a + out[-1] * (1 - a))
        return out

    got = I.macd(_bars(spark, closes), KEY, 5, 11, 4, bucket="day", window=60, chunk_rows=80).orderBy("pos").collect()
    assert len(got) == 300
    for i, row in enumerate(got):
        window = closes[max(0, i - 59) : i + 1]
        line = [f - s for f, s in zip(ema(window, 5), ema(window, 11), strict=True)]
        hist = [m - s for m, s in zip(line, ema(line, 4), strict=True)]
        assert row["ema"] == pytest.approx(ema(window, 5)[-1])
        if i + 1 >= 17:
            assert row["histogram"] == pytest.approx(hist[-1], abs=1e-9)
            assert row["prev_histogram"] == pytest.approx(hist[-2], abs=1e-9)
        else:
            assert row["histogram"] is None
