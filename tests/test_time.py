from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import calendar as cal
from tickloom.operators import intervals as iv
from tickloom.operators import joins as J


def _ts(text):
    return dt.datetime.fromisoformat(text)


def test_session_hours_follow_local_time(spark, calendar):
    days = {str(r["session_date"]): r for r in calendar.collect()}
    assert len(days) == 4018
    assert days["2024-01-02"]["opens_at"] == _ts("2024-01-02 14:30:00")
    assert days["2024-07-02"]["closes_at"] == _ts("2024-07-02 20:00:00")
    assert days["2024-07-03"]["closes_at"] == _ts("2024-07-03 17:00:00")
    assert days["2024-07-04"]["session_type"] == "CLOSED"
    assert days["2024-07-04"]["opens_at"] is None
    assert days["2024-07-04"]["next_session_date"] == dt.date(2024, 7, 5)


def test_calendar_refuses_unknown_range(spark):
    with pytest.raises(ValueError, match="outside"):
        cal.sessions(spark, "2015-12-31", "2016-02-01")


def test_status_and_next_session(spark, calendar):
    rows = [
        ("2024-01-02 14:29:59", "PRE_MARKET", "2024-01-02"),
        ("2024-01-02 14:30:00", "REGULAR_OPEN", "2024-01-03"),
        ("2024-01-02 21:00:00", "POST_MARKET", "2024-01-03"),
        ("2024-01-06 15:00:00", "MARKET_CLOSED", "2024-01-08"),
        ("2030-01-02 15:00:00", "CALENDAR_UNAVAILABLE", None),
    ]
    df = spark.createDataFrame([(_ts(t),) for t, _, _ in rows], "ts timestamp")
    got = {str(r["ts"]): r for r in cal.next_session(cal.session_status(df, "ts", calendar), "ts", calendar).collect()}
    for t, status, following in rows:
        assert got[t]["session_status"] == status
        assert (str(got[t]["next_session_date"]) if following else got[t]["next_session_date"]) == following


def test_signal_at_close_moves_to_next_session(spark, calendar):
    df = spark.createDataFrame([(_ts("2024-01-05 21:00:00"),), (_ts("2024-01-05 20:30:00"),), (_ts("2024-01-05 13:00:00"),)], "ts timestamp")
    got = [tuple(r) for r in cal.eligible_session(df, "ts", calendar).orderBy("ts").select("session_date_et", "eligible_at", "expires_at").collect()]
    assert got[0] == (None, None, None)
    assert got[1] == (dt.date(2024, 1, 5), _ts("2024-01-05 20:30:00"), _ts("2024-01-05 21:00:00"))
    assert got[2] == (dt.date(2024, 1, 8), _ts("2024-01-08 14:30:00"), _ts("2024-01-08 21:00:00"))


def test_asof_bounds(spark):
    left = spark.createDataFrame([("a", _ts("2024-01-01 10:00:00")), ("a", _ts("2024-02-01 00:00:00")), ("b", _ts("2024-01-01 10:00:00"))], "k string, t timestamp")
    right = spark.createDataFrame([("a", _ts("2024-01-01 09:30:00"), 1), ("a", _ts("2024-01-01 10:00:00"), 2)], "k string, r timestamp, v int")
    strict = {(x["k"], str(x["t"])): x["v"] for x in J.asof(left, right, ["k"], "t", "r", ["v"], strict=True).collect()}
    loose = {(x["k"], str(x["t"])): x["v"] for x in J.asof(left, right, ["k"], "t", "r", ["v"]).collect()}
    capped = {(x["k"], str(x["t"])): x["v"] for x in J.asof(left, right, ["k"], "t", "r", ["v"], tolerance_seconds=60).collect()}
    ahead = {(x["k"], str(x["t"])): x["v"] for x in J.asof(left, right, ["k"], "t", "r", ["v"], forward=True).collect()}
    assert strict == {("a", "2024-01-01 10:00:00"): 1, ("a", "2024-02-01 00:00:00"): 2, ("b", "2024-01-01 10:00:00"): None}
    assert loose[("a", "2024-01-01 10:00:00")] == 2
    assert capped[("a", "2024-02-01 00:00:00")] is None
    assert ahead == {("a", "2024-01-01 10:00:00"): 2, ("a", "2024-02-01 00:00:00"): None, ("b", "2024-01-01 10:00:00"): None}


def _iv(spark, rows):
    at = lambda m: dt.datetime(2024, 1, 31, 23, 0) + dt.timedelta(minutes=m)
    return spark.createDataFrame([(k, at(a), at(b)) for k, a, b in rows], "k string, starts_at timestamp, ends_at timestamp")


def _minutes(df):
    base = dt.datetime(2024, 1, 31, 23, 0)
    return sorted((r["k"], int((r["starts_at"] - base).total_seconds() // 60), int((r["ends_at"] - base).total_seconds() // 60)) for r in df.collect())


def test_merge_touching_and_nested(spark):
    df = _iv(spark, [("a", 0, 10), ("a", 10, 20), ("a", 5, 8), ("a", 30, 200), ("a", 40, 50), ("a", 150, 160), ("b", 70, 80)])
    assert _minutes(iv.coalesce_intervals(df, ["k"])) == [("a", 0, 20), ("a", 30, 200), ("b", 70, 80)]


def test_gaps_with_empty_and_full_cover(spark):
    target = _iv(spark, [("a", 0, 100), ("b", 0, 100), ("c", 0, 100)])
    have = _iv(spark, [("a", 10, 20), ("a", 15, 40), ("a", 90, 300), ("b", 0, 100)])
    assert _minutes(iv.gaps(target, have, ["k"])) == [("a", 0, 10), ("a", 40, 90), ("c", 0, 100)]


def test_points_divide_a_gap(spark):
    """An interval without length divides the gap it lies in, unless another interval touches it or it lies on the target's edge."""
    df = _iv(spark, [("a", 10, 20), ("a", 20, 20), ("a", 30, 30), ("a", 40, 50), ("a", 40, 40), ("a", 100, 100), ("b", 60, 60)])
    target = _iv(spark, [("a", 0, 100), ("b", 0, 100)])
    assert _minutes(iv.gaps(target, df, ["k"], points=True)) == [("a", 0, 10), ("a", 20, 30), ("a", 30, 40), ("a", 50, 100), ("b", 0, 60), ("b", 60, 100)]
    assert _minutes(iv.gaps(target, df, ["k"])) == [("a", 0, 10), ("a", 20, 40), ("a", 50, 100), ("b", 0, 100)]


def test_common_needs_every_member(spark):
    rows = [("a", 0, 50), ("a", 45, 60), ("b", 10, 30), ("b", 55, 70)]
    df = _iv(spark, rows).withColumn("g", F.lit("g"))
    sizes = spark.createDataFrame([("g", 2)], "g string, n long")
    got = iv.common(df, ["g"], "k", sizes).withColumnRenamed("g", "k")
    assert _minutes(got) == [("g", 10, 30), ("g", 55, 60)]


def test_uuid5_and_money(spark):
    names = ["alpha", "β:1", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["u"] for r in df.select("n", S.uuid5("n").alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}
    values = spark.createDataFrame([("0.000000005",), ("0.000000015",), ("-0.000000001",), ("99999999999999999",)], "v string").select(
        F.col("v").cast("decimal(38,12)").alias("v")
    )
    texts = [r[0] for r in values.select(S.format_money(S.quantize_money("v"))).collect()]
    assert texts == ["0.00000000", "0.00000002", "0.00000000", None]


def test_prorate_has_no_double_rounding(spark):
    # 0.00000123456785001 scaled: the ninth digit alone would look like a tie
    df = spark.createDataFrame([("1.00000000", "0.12345679", "1.00000001")], "a string, p string, w string").select(*[F.col(c).cast("decimal(18,8)").alias(c) for c in "apw"])
    from fractions import Fraction

    exact = Fraction("1.00000000") * Fraction("0.12345679") / Fraction("1.00000001")
    got = df.select(S.prorate(F.col("a"), F.col("p"), F.col("w"))).first()[0]
    assert abs(Fraction(str(got)) - exact) <= Fraction(1, 2 * 10**8)


def test_unavailable_requirements_lists_what_each_run_lacks(spark):
    rows = [(1, "b", "X"), (1, "a", "X"), (1, "c", None), (2, "a", "X"), (2, "ab", "Y"), (3, "a", None)]
    assessed = spark.createDataFrame(rows, "run_id int, requirement_id string, reason_code string")
    found = sorted(tuple(r) for r in iv.unavailable_requirements(assessed, prefix=1).collect())
    assert found == [(1, "X", 1, "a:X"), (1, "X", 2, "b:X"), (2, "REQUIRED_DATA_UNAVAILABLE", 1, "a:X"), (2, "REQUIRED_DATA_UNAVAILABLE", 2, "ab:Y")]
    assert iv.unavailable_requirements(assessed.filter("false")).count() == 0


def test_stage_allowed_fills_need_the_session_and_their_own_skips(spark, calendar):
    at = [dt.datetime(2024, 1, 3, 13, 0), dt.datetime(2024, 1, 3, 15, 0), dt.datetime(2024, 1, 3, 16, 0), dt.datetime(2024, 1, 6, 16, 0)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "k int, i int, ts timestamp")
    skips = spark.createDataFrame(
        [(1, at[1], at[2], ["FILL"]), (1, at[3], at[3] + dt.timedelta(hours=1), None)], "k int, starts_at timestamp, ends_at timestamp, stages array<string>"
    )
    allowed = {s: sorted(r["i"] for r in J.stage_allowed(rows, "ts", s, skips, ["k"], calendar).collect()) for s in J.STAGES}
    assert allowed == {"EVALUATION": [0, 1, 2], "ORDER_TRIGGER": [0, 1, 2], "FILL": [2]}
    everywhere = J.stage_allowed(rows, "ts", "EVALUATION", skips.drop("stages"), ["k"], calendar)
    assert sorted(r["i"] for r in everywhere.collect()) == [0, 2]
