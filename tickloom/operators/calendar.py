"""Exchange session calendar.

The calendar is a dimension of one row per date, about 4 000 rows for eleven years whatever the data volume, so it is the
one table that is always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
MIC = "XNYS"
CALENDAR_VERSION = "xnys-2016-2026:1.0.0"
COVERED_FROM = "2016-01-01"
COVERED_THROUGH = "2026-12-31"

# Full-day closures of the exchange.
CLOSED_DATES = """
2016-01-01 2016-01-18 2016-02-15 2016-03-25 2016-05-30 2016-07-04 2016-09-05 2016-11-24 2016-12-26
2017-01-02 2017-01-16 2017-02-20 2017-04-14 2017-05-29 2017-07-04 2017-09-04 2017-11-23 2017-12-25
2018-01-01 2018-01-15 2018-02-19 2018-03-30 2018-05-28 2018-07-04 2018-09-03 2018-11-22 2018-12-05 2018-12-25
2019-01-01 2019-01-21 2019-02-18 2019-04-19 2019-05-27 2019-07-04 2019-09-02 2019-11-28 2019-12-25
2020-01-01 2020-01-20 2020-02-17 2020-04-10 2020-05-25 2020-07-03 2020-09-07 2020-11-26 2020-12-25
2021-01-01 2021-01-18 2021-02-15 2021-04-02 2021-05-31 2021-07-05 2021-09-06 2021-11-25 2021-12-24
2022-01-17 2022-02-21 2022-04-15 2022-05-30 2022-06-20 2022-07-04 2022-09-05 2022-11-24 2022-12-26
2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25
2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25
2025-01-01 2025-01-09 2025-01-20 2025-02-17 2025-04-18 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-11-27
2025-12-25
2026-01-01 2026-01-19 2026-02-16 2026-04-03 2026-05-25 2026-06-19 2026-07-03 2026-09-07 2026-11-26 2026-12-25
""".split()

# Sessions that close at 13:00 local time.
EARLY_CLOSE_DATES = """
2016-11-25 2017-07-03 2017-11-24 2018-07-03 2018-11-23 2018-12-24 2019-07-03 2019-11-29 2019-12-24
2020-11-27 2020-12-24 2021-11-26 2022-11-25 2023-07-03 2023-11-24 2024-07-03 2024-11-29 2024-12-24
2025-07-03 2025-11-28 2025-12-24 2026-11-27 2026-12-24
""".split()

OPEN_LOCAL, CLOSE_LOCAL, EARLY_CLOSE_LOCAL = "09:30:00", "16:00:00", "13:00:00"


def et_date(ts: Column | str, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone))


def et_month(ts: Column | str, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone), "yyyy-MM")


def et_week(ts: Column | str, zone: str = ZONE) -> Column:
    """Monday of the local week."""
    return F.to_date(F.date_trunc("week", F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone)))


def release_quarter(ts: Column | str, zone: str = ZONE) -> Column:
    local = F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone)
    return F.concat(F.year(local).cast("string"), F.lit("-Q"), F.quarter(local).cast("string"))


def sessions(spark: SparkSession, first: str = COVERED_FROM, last: str = COVERED_THROUGH) -> DataFrame:
    """One row per calendar date, closed dates included with NULL open and close.

    A range outside the pinned coverage is refused: unknown dates are not closed dates.
    """
    if first > last or first < COVERED_FROM or last > COVERED_THROUGH:
        raise ValueError(f"calendar range {first}..{last} is outside {COVERED_FROM}..{COVERED_THROUGH}")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("session_date"))
    text = F.col("session_date").cast("string")
    kind = (
        F.when(F.dayofweek("session_date").isin(1, 7) | text.isin(CLOSED_DATES), "CLOSED")
        .when(text.isin(EARLY_CLOSE_DATES), "EARLY_CLOSE")
        .otherwise("REGULAR")
    )

    def instant(clock: Column) -> Column:
        return F.to_utc_timestamp(F.concat_ws(" ", text, clock).cast("timestamp"), ZONE)

    closing = F.when(F.col("session_type") == "EARLY_CLOSE", EARLY_CLOSE_LOCAL).otherwise(CLOSE_LOCAL)
    is_open = F.col("session_type") != "CLOSED"
    return days.withColumn("session_type", kind).select(
        F.lit(MIC).alias("exchange_mic"),
        "session_date",
        F.when(is_open, instant(F.lit(OPEN_LOCAL))).alias("opens_at"),
        F.when(is_open, instant(closing)).alias("closes_at"),
        "session_type",
        F.lit(CALENDAR_VERSION).alias("calendar_version"),
    )


def trading_sessions(calendar: DataFrame) -> DataFrame:
    return calendar.filter(F.col("session_type") != "CLOSED")


def _one_calendar() -> Column:
    """Windows over the calendar run per exchange: at most a few thousand rows each."""
    return F.col("exchange_mic")


def session_index(calendar: DataFrame) -> DataFrame:
    """Open sessions with 1-based index, neighbours and first/last-of-period properties."""
    if "session_index" in calendar.columns:
        return trading_sessions(calendar)
    w = Window.partitionBy(_one_calendar()).orderBy("session_date")
    day = F.col("session_date")
    open_days = trading_sessions(calendar)
    with_neighbours = open_days.select(
        "*",
        F.row_number().over(w).alias("session_index"),
        F.lag("session_date").over(w).alias("_prev"),
        F.lead("session_date").over(w).alias("_next"),
        F.lead("opens_at").over(w).alias("next_opens_at"),
        F.lead("closes_at").over(w).alias("next_closes_at"),
    )
    return with_neighbours.select(
        "exchange_mic",
        "session_date",
        "opens_at",
        "closes_at",
        "session_type",
        "session_index",
        F.col("_next").alias("next_session_date"),
        "next_opens_at",
        "next_closes_at",
        (F.col("_prev").isNull() | (F.date_trunc("week", "_prev") != F.date_trunc("week", day))).alias("week_first"),
        (F.col("_prev").isNull() | (F.date_trunc("month", "_prev") != F.date_trunc("month", day))).alias("month_first"),
        (F.col("_next").isNull() | (F.date_trunc("month", "_next") != F.date_trunc("month", day))).alias("month_last"),
    )


def session_status(df: DataFrame, ts: str, calendar: DataFrame, out: str = "session_status") -> DataFrame:
    """PRE_MARKET, REGULAR_OPEN (close exclusive), POST_MARKET, MARKET_CLOSED or CALENDAR_UNAVAILABLE."""
    days = F.broadcast(
        calendar.select(F.col("session_date").alias("_d"), F.col("opens_at").alias("_o"), F.col("closes_at").alias("_c"))
    )
    at = F.col(ts)
    status = (
        F.when(F.col("_d").isNull(), "CALENDAR_UNAVAILABLE")
        .when(F.col("_o").isNull(), "MARKET_CLOSED")
        .when(at < F.col("_o"), "PRE_MARKET")
        .when(at < F.col("_c"), "REGULAR_OPEN")
        .otherwise("POST_MARKET")
    )
    return df.join(days, et_date(ts) == F.col("_d"), "left").withColumn(out, status).drop("_d", "_o", "_c")


def indexed(calendar: DataFrame) -> DataFrame:
    """All dates with the index columns of ``session_index``; closed dates carry only the following session."""
    w = Window.partitionBy(_one_calendar()).orderBy("session_date").rowsBetween(1, Window.unboundedFollowing)
    opened = F.when(F.col("opens_at").isNotNull(), F.struct("session_date", "opens_at", "closes_at"))
    following = calendar.withColumn("_f", F.first(opened, ignorenulls=True).over(w))
    index = session_index(calendar).select("session_date", "session_index", "week_first", "month_first", "month_last")
    return following.join(index, "session_date", "left").select(
        *calendar.columns,
        "session_index",
        F.col("_f.session_date").alias("next_session_date"),
        F.col("_f.opens_at").alias("next_opens_at"),
        F.col("_f.closes_at").alias("next_closes_at"),
        "week_first",
        "month_first",
        "month_last",
    )


def pinned(spark: SparkSession) -> DataFrame:
    """The whole indexed calendar as a local relation, built once per session.

    Its size is fixed by the coverage (4 018 dates), so holding it on the driver and broadcasting it is safe.
    """
    held = getattr(spark, "_tickloom_calendar", None)
    if held is None:
        frame = indexed(sessions(spark))
        held = spark.createDataFrame(frame.toArrow())
        spark._tickloom_calendar = held
    return held


def next_session(df: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """The first session opening strictly after ``ts``.

    Per date the answer is one of two sessions: the date's own one while it has not opened, else the following one. Both
    are columns of the calendar row, which turns the range search into one broadcast equi-join.
    """
    full = calendar if "session_index" in calendar.columns else indexed(calendar)
    days = full.select(
        F.col("session_date").alias("_d"), F.col("opens_at").alias("_o"), F.col("closes_at").alias("_c"),
        F.col("next_session_date").alias("_nd"), F.col("next_opens_at").alias("_no"), F.col("next_closes_at").alias("_nc"),
    )
    early = F.col(ts) < F.col("_o")
    return df.join(F.broadcast(days), et_date(ts) == F.col("_d"), "left").select(
        *df.columns,
        F.when(early, F.col("_d")).otherwise(F.col("_nd")).alias("next_session_date"),
        F.when(early, F.col("_o")).otherwise(F.col("_no")).alias("next_opens_at"),
        F.when(early, F.col("_c")).otherwise(F.col("_nc")).alias("next_closes_at"),
    )


def trading_days_between(df: DataFrame, start: str, end: str, calendar: DataFrame, out: str = "trading_days") -> DataFrame:
    """Sessions elapsed from ``start`` to ``end`` (opening session is day zero, never negative).

    A date that is no session has no index: the result is NULL, to be treated as an error by the caller.
    """
    index = session_index(calendar)
    a = F.broadcast(index.select(F.col("session_date").alias("_sd"), F.col("session_index").alias("_si")))
    b = F.broadcast(index.select(F.col("session_date").alias("_ed"), F.col("session_index").alias("_ei")))
    joined = df.join(a, F.col(start) == F.col("_sd"), "left").join(b, F.col(end) == F.col("_ed"), "left")
    value = F.when(F.col("_si").isNotNull() & F.col("_ei").isNotNull(), F.greatest(F.lit(0), F.col("_ei") - F.col("_si")))
    return joined.withColumn(out, value).drop("_sd", "_si", "_ed", "_ei")


def schedule_flags(bars: DataFrame, instant: str, keys: list[str], calendar: DataFrame) -> DataFrame:
    """Schedule properties of each evaluation instant; period flags are true only on the day's first instant.

    The window is per (keys, session date): bounded by the instants of one session.
    """
    index = session_index(calendar)
    days = F.broadcast(
        index.select(
            F.col("session_date").alias("_d"),
            F.col("closes_at").alias("_c"),
            F.col("session_index").alias("trading_day_index"),
            F.col("week_first").alias("_wf"),
            F.col("month_first").alias("_mf"),
            F.col("month_last").alias("_ml"),
        )
    )
    joined = bars.join(days, et_date(instant) == F.col("_d"))
    first_of_day = F.col(instant) == F.min(instant).over(Window.partitionBy(*keys, "_d"))
    return (
        joined.withColumn("session_close", F.col(instant) >= F.col("_c"))
        .withColumn("new_trading_day", first_of_day)
        .withColumn("week_first_day", F.col("new_trading_day") & F.col("_wf"))
        .withColumn("month_first_day", F.col("new_trading_day") & F.col("_mf"))
        .withColumn("month_last_day", F.col("new_trading_day") & F.col("_ml"))
        .drop("_d", "_c", "_wf", "_mf", "_ml")
    )


def closed_gaps(calendar: DataFrame) -> DataFrame:
    """All closed-market intervals of the calendar: one row per session boundary, bounded by its dates."""
    index = session_index(calendar)
    edge = calendar.groupBy("exchange_mic").agg(
        F.min("session_date").alias("_first"), F.date_add(F.max("session_date"), 1).alias("_last"), F.min("opens_at").alias("_open")
    )
    local_midnight = lambda day: F.to_utc_timestamp(F.col(day).cast("timestamp"), ZONE)
    head = edge.select(local_midnight("_first").alias("starts_at"), F.col("_open").alias("ends_at"))
    inner = index.join(F.broadcast(edge), "exchange_mic").select(
        F.col("closes_at").alias("starts_at"), F.coalesce("next_opens_at", local_midnight("_last")).alias("ends_at")
    )
    return head.unionByName(inner)


def closed_intervals(calendar: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Complement of the sessions inside each window ``[starts_at, ends_at)``."""
    from tickloom.operators.joins import overlap

    found = overlap(windows, closed_gaps(calendar), [], unit="month")
    return found.select(*keys, F.col("overlap_start").alias("starts_at"), F.col("overlap_end").alias("ends_at"))


def eligible_session(signals: DataFrame, instant: str, calendar: DataFrame) -> DataFrame:
    """When may an order created at ``instant`` first trade, and when does its day end?

    A signal at or after the close belongs to the next session (eligible at its open); a signal inside a session is
    eligible at the decision instant and ends with that session. Outside any session: NULL.
    """
    index = session_index(calendar)
    days = F.broadcast(
        index.select(
            F.col("session_date").alias("_d"),
            F.col("opens_at").alias("_o"),
            F.col("closes_at").alias("_c"),
            F.col("next_session_date").alias("_nd"),
            F.col("next_opens_at").alias("_no"),
            F.col("next_closes_at").alias("_nc"),
        )
    )
    joined = signals.join(days, et_date(instant) == F.col("_d"), "left")
    late = F.col(instant) >= F.col("_c")
    inside = (F.col(instant) >= F.col("_o")) & ~late
    return (
        joined.withColumn("session_date_et", F.when(late, F.col("_nd")).when(inside, F.col("_d")))
        .withColumn("eligible_at", F.when(late, F.col("_no")).when(inside, F.col(instant)))
        .withColumn("expires_at", F.when(late, F.col("_nc")).when(inside, F.col("_c")))
        .drop("_d", "_o", "_c", "_nd", "_no", "_nc")
    )


def policy_for(releases: DataFrame, ts: str, policies: DataFrame) -> DataFrame:
    """The execution policy of the release's quarter; NULL policy means none is published."""
    return releases.withColumn("release_quarter", release_quarter(ts)).join(policies, "release_quarter", "left")
