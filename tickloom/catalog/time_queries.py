"""Calendar, bars, joins over time, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import sql as Q
from tickloom.catalog.base import num, query
from tickloom.catalog.inputs import calendar, event_bar_events, event_bars
from tickloom.functions import scalars as S
from tickloom.operators import bars as B
from tickloom.operators import calendar as cal
from tickloom.operators import intervals as iv
from tickloom.operators import joins as J
from tickloom.operators.scan import in_chunks, with_position
from tickloom.sources.tables import table

# ---------------------------------------------------------------- calendar


@query(
    "calendar_sessions",
    f"""WITH {Q.CALENDAR},
    n AS (SELECT {Q.et_date("ts")} AS d, count(*) AS n FROM events GROUP BY 1)
    SELECT c.session_date, c.session_type, c.opens_at, c.closes_at, CAST(coalesce(n.n, 0) AS BIGINT) AS events
    FROM cal c LEFT JOIN n ON n.d = c.session_date""",
)
def calendar_sessions(spark, folder):
    """Every calendar date with its session and the activity of the events table on it."""
    n = table(spark, folder, "events").groupBy(cal.et_date("ts").alias("session_date")).agg(F.count(F.lit(1)).alias("events"))
    return (
        calendar(spark)
        .join(n, "session_date", "left")
        .select("session_date", "session_type", "opens_at", "closes_at", F.coalesce("events", F.lit(0)).alias("events"))
    )


@query(
    "trading_sessions",
    f"""WITH {Q.CALENDAR}
    SELECT s.session_date, CAST(s.session_index AS INTEGER) AS session_index, count(*) AS events
    FROM ses s JOIN events e ON {Q.et_date("e.ts")} = s.session_date AND e.ts >= s.opens_at AND e.ts < s.closes_at
    GROUP BY ALL""",
)
def trading_sessions(spark, folder):
    index = F.broadcast(cal.session_index(calendar(spark)))
    events = table(spark, folder, "events").select("ts")
    return (
        events.join(index, cal.et_date("ts") == F.col("session_date"))
        .filter("ts >= opens_at AND ts < closes_at")
        .groupBy("session_date", "session_index")
        .agg(F.count(F.lit(1)).alias("events"))
    )


_STATUS = f"""CASE WHEN c.session_date IS NULL THEN 'CALENDAR_UNAVAILABLE' WHEN c.opens_at IS NULL THEN 'MARKET_CLOSED'
    WHEN x.ts < c.opens_at THEN 'PRE_MARKET' WHEN x.ts < c.closes_at THEN 'REGULAR_OPEN' ELSE 'POST_MARKET' END"""


@query(
    "session_status",
    f"""WITH {Q.CALENDAR}, x AS (SELECT 'events' AS source, ts FROM events UNION ALL SELECT 'lineitem', l_shipdate FROM lineitem)
    SELECT source, {_STATUS} AS session_status, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
    FROM x LEFT JOIN cal c ON c.session_date = {Q.et_date("x.ts")} GROUP BY ALL""",
)
def session_status(spark, folder):
    stamps = (
        table(spark, folder, "events").select(F.lit("events").alias("source"), "ts")
        .unionByName(table(spark, folder, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_shipdate").alias("ts")))
    )
    return (
        cal.session_status(stamps, "ts", calendar(spark))
        .groupBy("source", "session_status")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


@query(
    "next_session",
    f"""WITH {Q.CALENDAR}
    SELECT event_id, s.session_date AS next_session_date, s.opens_at AS next_opens_at
    FROM events e ASOF JOIN ses s ON e.ts < s.opens_at""",
)
def next_session(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return cal.next_session(events, "ts", calendar(spark)).select("event_id", "next_session_date", "next_opens_at")


@query(
    "trading_days_between",
    f"""WITH {Q.CALENDAR}, u AS (SELECT user_id, {Q.et_date("min(ts)")} AS a, {Q.et_date("max(ts)")} AS b FROM events GROUP BY 1)
    SELECT user_id, a AS first_date, b AS last_date,
      CAST(CASE WHEN x.session_index IS NOT NULL AND y.session_index IS NOT NULL THEN greatest(0, y.session_index - x.session_index) END AS INTEGER) AS trading_days
    FROM u LEFT JOIN ses x ON x.session_date = a LEFT JOIN ses y ON y.session_date = b""",
)
def trading_days_between(spark, folder):
    spans = table(spark, folder, "events").groupBy("user_id").agg(
        cal.et_date(F.min("ts")).alias("first_date"), cal.et_date(F.max("ts")).alias("last_date")
    )
    return cal.trading_days_between(spans, "first_date", "last_date", calendar(spark))


_B30 = f"{Q.CALENDAR}, {Q.TICKS}, {Q.bars(1800)}"


@query(
    "schedule_flags",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)},
    f AS (SELECT e.*, s.session_index, s.prev_date, s.next_date, s.session_date,
          e.ends_at = min(e.ends_at) OVER (PARTITION BY instrument_id, s.session_date) AS nd
          FROM ev e JOIN ses s ON s.session_date = {Q.et_date("e.ends_at")})
    SELECT instrument_id, ends_at AS occurred_at, CAST(session_index AS INTEGER) AS trading_day_index, ends_at >= closes_at AS session_close,
      nd AS new_trading_day,
      nd AND (prev_date IS NULL OR date_trunc('week', prev_date) <> date_trunc('week', session_date)) AS week_first_day,
      nd AND (prev_date IS NULL OR date_trunc('month', prev_date) <> date_trunc('month', session_date)) AS month_first_day,
      nd AND (next_date IS NULL OR date_trunc('month', next_date) <> date_trunc('month', session_date)) AS month_last_day
    FROM f""",
)
def schedule_flags(spark, folder):
    ev = event_bar_events(spark, folder).select("instrument_id", "occurred_at")
    return cal.schedule_flags(ev, "occurred_at", ["instrument_id"], calendar(spark))


@query(
    "closed_intervals",
    f"""WITH {Q.CALENDAR}, w AS (SELECT event_type AS instrument_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1),
    g AS (SELECT closes_at AS s, next_open AS e FROM ses WHERE next_open IS NOT NULL)
    SELECT instrument_id, greatest(s, a) AS starts_at, least(e, b) AS ends_at FROM w JOIN g ON s < b AND a < e""",
)
def closed_intervals(spark, folder):
    windows = table(spark, folder, "events").groupBy(F.col("event_type").alias("instrument_id")).agg(
        F.min("ts").alias("starts_at"), F.max("ts").alias("ends_at")
    )
    return cal.closed_intervals(calendar(spark), windows, ["instrument_id"])


@query(
    "release_policy",
    f"""WITH p AS (SELECT year({Q.et("l_shipdate")}) || '-Q' || quarter({Q.et("l_shipdate")}) AS release_quarter, max(l_tax) AS fee_rate
        FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey, year({Q.et("o_orderdate")}) || '-Q' || quarter({Q.et("o_orderdate")}) AS release_quarter FROM orders)
    SELECT r.o_orderkey AS release_id, r.release_quarter, p.fee_rate, CASE WHEN p.fee_rate IS NULL THEN 'POLICY_UNAVAILABLE' ELSE 'OK' END AS status
    FROM r LEFT JOIN p USING (release_quarter)""",
)
def release_policy(spark, folder):
    policies = (
        table(spark, folder, "lineitem")
        .groupBy(cal.release_quarter("l_shipdate").alias("release_quarter"))
        .agg(F.max("l_tax").alias("fee_rate"))
    )
    releases = table(spark, folder, "orders").select(F.col("o_orderkey").alias("release_id"), "o_orderdate")
    return cal.policy_for(releases, "o_orderdate", policies).select(
        "release_id", "release_quarter", "fee_rate", F.when(F.col("fee_rate").isNull(), "POLICY_UNAVAILABLE").otherwise("OK").alias("status")
    )


@query(
    "et_periods",
    f"""SELECT strftime({Q.et("ts")}, '%Y-%m') AS et_month, CAST(date_trunc('week', {Q.et("ts")}) AS DATE) AS et_week, event_type, count(*) AS n
    FROM events GROUP BY ALL""",
)
def et_periods(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy(cal.et_month("ts").alias("et_month"), cal.et_week("ts").alias("et_week"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_ELIGIBLE = f"""SELECT e.event_id, e.event_type AS instrument_id, e.ts,
      CASE WHEN e.ts >= s.closes_at THEN s.next_date WHEN e.ts >= s.opens_at THEN s.session_date END AS session_date_et,
      CASE WHEN e.ts >= s.closes_at THEN s.next_open WHEN e.ts >= s.opens_at THEN e.ts END AS eligible_at,
      CASE WHEN e.ts >= s.closes_at THEN s.next_close WHEN e.ts >= s.opens_at THEN s.closes_at END AS expires_at
    FROM events e LEFT JOIN ses s ON s.session_date = {Q.et_date("e.ts")}"""


@query("eligible_session", f"WITH {Q.CALENDAR} {_ELIGIBLE}")
def eligible_session(spark, folder):
    signals = table(spark, folder, "events").select("event_id", F.col("event_type").alias("instrument_id"), "ts")
    return cal.eligible_session(signals, "ts", calendar(spark))


# ---------------------------------------------------------------- bars


def _bar_columns():
    return ["instrument_id", "bar_start_at", "session_date_et", num("open").alias("open"), num("high").alias("high"), num("low").alias("low"), num("close").alias("close"), "volume"]


_BAR_SQL = f"""instrument_id, bar_start_at, session_date_et, {Q.num("open")} AS open, {Q.num("high")} AS high, {Q.num("low")} AS low,
    {Q.num("close")} AS close, volume"""


@query("bars_30m", f"WITH {_B30} SELECT {_BAR_SQL} FROM bars")
def bars_30m(spark, folder):
    return event_bars(spark, folder).select(*_bar_columns())


@query(
    "bars_daily",
    f"""WITH {Q.CALENDAR}, {Q.TICKS},
    bars AS (SELECT instrument_id, c.opens_at AS bar_start_at, c.session_date AS session_date_et, arg_min(px, ts) AS open, max(px) AS high,
      min(px) AS low, arg_max(px, ts) AS close, count(*) AS volume FROM ticks t JOIN cal c ON c.session_date = {Q.et_date("t.ts")}
      WHERE ts >= opens_at AND ts < closes_at GROUP BY instrument_id, c.opens_at, c.session_date)
    SELECT {_BAR_SQL} FROM bars""",
)
def bars_daily(spark, folder):
    ticks, px, qty = B.event_ticks(table(spark, folder, "events"))
    return B.daily_bars(ticks, ["instrument_id"], "ts", px, qty, "event_id", calendar(spark)).select(*_bar_columns())


@query(
    "bar_events_truncated",
    f"""WITH {Q.CALENDAR}, {Q.TICKS}, {Q.bars(14400)}, {Q.bar_events("4h", 14400)}
    SELECT instrument_id, starts_at, ends_at AS occurred_at, ends_at + INTERVAL 900 SECOND AS available_at,
      ends_at < starts_at + INTERVAL 14400 SECOND AS session_truncated, starts_at >= opens_at AND starts_at < closes_at AS in_session
    FROM ev""",
)
def bar_events_truncated(spark, folder):
    return event_bar_events(spark, folder, "4h", 900).select(
        "instrument_id", "starts_at", "occurred_at", "available_at", "session_truncated", "in_session"
    )


@query(
    "event_sequence",
    f"""WITH {Q.CALENDAR}, {Q.TICKS}, {Q.bars(1800, "b30")}, {Q.bars(3600, "b60")}, {Q.bar_events("30m", 1800, "b30", "e30")},
    {Q.bar_events("1h", 3600, "b60", "e60")},
    u AS (SELECT instrument_id, starts_at, ends_at, resolution, 1800 AS p FROM e30 UNION ALL SELECT instrument_id, starts_at, ends_at, resolution, 3600 FROM e60),
    k AS (SELECT *, instrument_id || ':' || strftime(starts_at, '%Y%m%dT%H%M%S') || ':' || resolution AS event_id FROM u)
    SELECT event_id, instrument_id, resolution, ends_at AS occurred_at,
      row_number() OVER (ORDER BY ends_at, p, instrument_id, event_id) AS sequence FROM k""",
)
def event_sequence(spark, folder):
    """Two resolutions of one run as a single numbered stream."""
    segments = [(r, event_bar_events(spark, folder, r).drop("resolution")) for r in ("30m", "1h")]
    events = B.union_segments(segments).withColumn("event_id", B.event_id(multi_resolution=True)).withColumn("run_id", F.lit("run"))
    numbered = B.sequence_events(events, ["run_id"], S.token_to_seconds("resolution"))
    return numbered.select("event_id", "instrument_id", "resolution", "occurred_at", "sequence")


@query(
    "event_clip",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)},
    r AS (SELECT event_type AS instrument_id, min(ts) + INTERVAL 3 DAY AS warmup_start, max(ts) - INTERVAL 5 DAY AS evaluation_end FROM events GROUP BY 1)
    SELECT instrument_id, ends_at AS occurred_at, {Q.num("close")} AS close FROM ev JOIN r USING (instrument_id)
    WHERE ends_at >= warmup_start AND ends_at <= evaluation_end""",
)
def event_clip(spark, folder):
    bounds = table(spark, folder, "events").groupBy(F.col("event_type").alias("instrument_id")).agg(
        (F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("warmup_start"), (F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("evaluation_end")
    )
    return B.clip_to_run(event_bar_events(spark, folder), bounds, ["instrument_id"]).select("instrument_id", "occurred_at", num("close").alias("close"))


@query(
    "visible_window",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)}
    SELECT instrument_id, ends_at AS occurred_at, count(*) OVER w AS visible_bars, min(starts_at) OVER w AS oldest_start,
      {Q.num("sum(close) OVER w")} AS close_sum FROM ev
    WINDOW w AS (PARTITION BY instrument_id ORDER BY starts_at ROWS BETWEEN 179 PRECEDING AND CURRENT ROW)""",
)
def visible_window(spark, folder):
    """The last 180 visible bars of each series at each instant."""
    events = event_bar_events(spark, folder).select("instrument_id", "starts_at", "occurred_at", "close")
    placed = with_position(events, ["instrument_id"], ["starts_at"], F.date_trunc("month", "starts_at"))

    def compute(df, w):
        frame = w.rowsBetween(-179, 0)
        return df.withColumns({"visible_bars": F.count(F.lit(1)).over(frame), "oldest_start": F.min("starts_at").over(frame), "close_sum": F.sum("close").over(frame)})

    return in_chunks(placed, ["instrument_id"], 179, compute).select(
        "instrument_id", "occurred_at", "visible_bars", "oldest_start", num("close_sum").alias("close_sum")
    )


@query(
    "completed_through",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)}
    SELECT instrument_id, count(*) AS bars, max(ends_at) AS last_end, {Q.num("arg_max(close, ends_at)")} AS last_close
    FROM ev WHERE ends_at <= TIMESTAMP '2024-01-16 18:10:00' GROUP BY 1""",
)
def completed_through(spark, folder):
    as_of = F.lit("2024-01-16 18:10:00").cast("timestamp")
    return (
        B.completed_through(event_bar_events(spark, folder), as_of)
        .groupBy("instrument_id")
        .agg(F.count(F.lit(1)).alias("bars"), F.max("ends_at").alias("last_end"), num(F.max_by("close", "ends_at")).alias("last_close"))
    )


@query(
    "series_observations",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)},
    w AS (SELECT instrument_id, min(starts_at) AS a, max(ends_at) AS b FROM ev GROUP BY 1),
    g AS (SELECT closes_at AS s, next_open AS e FROM ses WHERE next_open IS NOT NULL)
    SELECT instrument_id, starts_at, ends_at, 'BAR' AS source FROM ev
    UNION ALL SELECT instrument_id, greatest(s, a), least(e, b), 'CLOSED' FROM w JOIN g ON s < b AND a < e""",
)
def series_observations(spark, folder):
    return B.observations(event_bar_events(spark, folder), calendar(spark), ["instrument_id"])


# ---------------------------------------------------------------- joins


@query(
    "asof_join",
    """WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
    r AS (SELECT user_id, ts AS rts, value FROM events WHERE event_type = 'view')
    SELECT l.event_id, CASE WHEN date_diff('microsecond', r.rts, l.ts) <= 86400000000 THEN r.rts END AS view_ts,
      CASE WHEN date_diff('microsecond', r.rts, l.ts) <= 86400000000 THEN r.value END AS view_value
    FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.rts""",
)
def asof_join(spark, folder):
    """Last view of the same user strictly before each purchase, at most a day old."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    left = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    return J.asof(left, right, ["user_id"], "ts", "view_ts", ["view_ts", "view_value"], strict=True, tolerance_seconds=86_400).select(
        "event_id", "view_ts", "view_value"
    )


@query(
    "asof_supplier_price",
    f"""WITH {Q.SUPPLIER_DAYS}, g AS (SELECT DISTINCT 'S' || l_suppkey AS instrument_id, date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS at FROM lineitem)
    SELECT g.instrument_id, g.at, b.starts_at AS priced_at, {Q.num("b.close")} AS close
    FROM g ASOF LEFT JOIN sbars b ON g.instrument_id = b.instrument_id AND g.at >= b.starts_at""",
)
def asof_supplier_price(spark, folder):
    """State on a grid: the latest close of each supplier at each month start."""
    from tickloom.catalog.inputs import supplier_days

    bars = supplier_days(spark, folder)
    grid = table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("instrument_id"),
        (F.date_trunc("month", "l_shipdate") + F.expr("INTERVAL 1 MONTH")).alias("at"),
    ).distinct()
    return J.asof(grid, bars, ["instrument_id"], "at", "starts_at", ["starts_at", "close"], bucket=None).select(
        "instrument_id", "at", F.col("starts_at").alias("priced_at"), num("close").alias("close")
    )


@query(
    "reconcile_keys",
    """WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), h AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT coalesce(w.k, h.k) AS request_id, CASE WHEN h.k IS NULL THEN 'MISSING' WHEN w.k IS NULL THEN 'EXTRA' WHEN h.n > 1 THEN 'DUPLICATE' ELSE 'OK' END AS finding
    FROM w FULL JOIN h ON w.k = h.k""",
)
def reconcile_keys(spark, folder):
    required = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("request_id"))
    actual = table(spark, folder, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("request_id"))
    return J.reconcile(required, actual, ["request_id"])


@query(
    "next_bar",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)}, o AS ({_ELIGIBLE})
    SELECT o.event_id, CASE WHEN b.starts_at < o.expires_at THEN b.starts_at END AS fill_start,
      CASE WHEN b.starts_at < o.expires_at THEN {Q.num("b.open")} END AS fill_open
    FROM o ASOF LEFT JOIN ev b ON o.instrument_id = b.instrument_id AND o.eligible_at <= b.starts_at WHERE o.eligible_at IS NOT NULL""",
)
def next_bar(spark, folder):
    signals = eligible_session(spark, folder).filter("eligible_at IS NOT NULL")
    bars = event_bar_events(spark, folder).select("instrument_id", "starts_at", "open")
    return J.next_bar(signals, bars, ["starts_at", "open"], bucket="day").select(
        "event_id", F.col("starts_at").alias("fill_start"), num("open").alias("fill_open")
    )


@query(
    "bars_in_life",
    f"""WITH {_B30}, {Q.bar_events("30m", 1800)}, o AS ({_ELIGIBLE})
    SELECT o.event_id, count(*) AS bars, {Q.num("min(b.low)")} AS low, {Q.num("max(b.high)")} AS high
    FROM o JOIN ev b ON o.instrument_id = b.instrument_id AND b.starts_at >= o.eligible_at AND b.starts_at < o.expires_at GROUP BY 1""",
)
def bars_in_life(spark, folder):
    signals = eligible_session(spark, folder).filter("eligible_at IS NOT NULL")
    bars = event_bar_events(spark, folder).select("instrument_id", "starts_at", "session_date_et", "low", "high").withColumnRenamed("session_date_et", "bar_date")
    return (
        J.bars_in_life(signals, bars, F.col("session_date_et"), F.col("session_date_et"), "bar_date")
        .groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("bars"), num(F.min("low")).alias("low"), num(F.max("high")).alias("high"))
    )


_USER_IV = """iv AS (SELECT user_id, event_type, event_id, ts AS starts_at, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS ends_at FROM events)"""


def _user_intervals(spark, folder):
    return table(spark, folder, "events").select(
        "user_id", "event_type", "event_id", F.col("ts").alias("starts_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("long")).alias("ends_at"),
    )


@query(
    "interval_overlap",
    f"""WITH {_USER_IV}
    SELECT a.event_id, b.event_id AS other_id, greatest(a.starts_at, b.starts_at) AS overlap_start, least(a.ends_at, b.ends_at) AS overlap_end
    FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.starts_at < b.ends_at AND b.starts_at < a.ends_at
    WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND a.starts_at < a.ends_at AND b.starts_at < b.ends_at""",
)
def interval_overlap(spark, folder):
    spans = _user_intervals(spark, folder)
    a = spans.filter("event_type = 'view'").select("user_id", "event_id", "starts_at", "ends_at")
    b = spans.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other_id"), "starts_at", "ends_at")
    return J.overlap(a, b, ["user_id"]).select("event_id", "other_id", "overlap_start", "overlap_end")


@query(
    "outside_skips",
    f"""WITH {_USER_IV}
    SELECT e.event_id, e.user_id, e.ts FROM events e WHERE e.event_type <> 'error' AND NOT EXISTS (
      SELECT 1 FROM iv WHERE iv.event_type = 'error' AND iv.user_id = e.user_id AND e.ts >= iv.starts_at AND e.ts < iv.ends_at)""",
)
def outside_skips(spark, folder):
    events = table(spark, folder, "events").filter("event_type <> 'error'").select("event_id", "user_id", "ts")
    skips = _user_intervals(spark, folder).filter("event_type = 'error'").select("user_id", "starts_at", "ends_at")
    return J.outside(events, "ts", skips, ["user_id"])


@query(
    "stage_allowed",
    f"""WITH {Q.CALENDAR}, {_USER_IV}, x AS (SELECT e.event_id, e.ts, count(*) FILTER (iv.event_type = 'error') AS errors, count(*) FILTER (iv.event_type = 'purchase') AS purchases
      FROM events e LEFT JOIN iv ON iv.event_type IN ('error', 'purchase') AND iv.user_id = e.user_id AND e.ts >= iv.starts_at AND e.ts < iv.ends_at GROUP BY 1, 2),
    st AS (SELECT x.*, {_STATUS} AS status FROM x LEFT JOIN cal c ON c.session_date = {Q.et_date("x.ts")})
    SELECT event_id, 'EVALUATION' AS stage FROM st WHERE errors = 0 UNION ALL SELECT event_id, 'ORDER_TRIGGER' FROM st WHERE errors = 0
    UNION ALL SELECT event_id, 'FILL' FROM st WHERE errors + purchases = 0 AND status = 'REGULAR_OPEN'""",
)
def stage_allowed(spark, folder):
    """Stages that each instant permits: intervals of errors block all, those of purchases only fills."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    stages = F.when(F.col("event_type") == "purchase", F.array(F.lit("FILL")))
    skips = _user_intervals(spark, folder).filter("event_type IN ('error', 'purchase')").select("user_id", "starts_at", "ends_at", stages.alias("stages"))
    permitted = [J.stage_allowed(events, "ts", stage, skips, ["user_id"], calendar(spark)).select("event_id", F.lit(stage).alias("stage")) for stage in J.STAGES]
    return permitted[0].unionByName(permitted[1]).unionByName(permitted[2])


@query(
    "lineage_present",
    "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
def lineage_present(spark, folder):
    children = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return runs.join(children, "run_id", "left_semi")


@query(
    "latest_attempt",
    """SELECT o_orderkey AS run_id, o_orderstatus AS status, a.n AS attempt_number, a.f AS attempt_flag FROM orders LEFT JOIN
    (SELECT l_orderkey, max(l_linenumber) AS n, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS f FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey""",
)
def latest_attempt(spark, folder):
    attempts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt_number"), "l_partkey", "l_suppkey", F.col("l_returnflag").alias("attempt_flag")
    )
    last = J.latest_per_key(attempts, ["run_id"], ["attempt_number", "l_partkey", "l_suppkey"], ["attempt_flag"])
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return runs.join(last, "run_id", "left").select("run_id", "status", "attempt_number", "attempt_flag")


@query(
    "provider_chain",
    """SELECT s_suppkey AS feed_id, n_name AS provider, r_name AS region, count(l_orderkey) AS objects, CAST(sum(l_quantity) AS BIGINT) AS row_count
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def provider_chain(spark, folder):
    """Manifest to feed to provider lookups; the aggregate runs before the joins."""
    objects = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("feed_id")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("l_quantity").cast("long").alias("row_count")
    )
    feeds = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("feed_id"), F.col("s_nationkey").alias("n_nationkey"))
    providers = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        feeds.join(providers, "n_nationkey")
        .join(objects, "feed_id", "left")
        .select("feed_id", F.col("n_name").alias("provider"), F.col("r_name").alias("region"), F.coalesce("objects", F.lit(0)).alias("objects"), "row_count")
    )


@query(
    "content_corrections",
    """WITH o AS (SELECT l_suppkey AS run_id, date_trunc('month', l_shipdate) AS part, sha256(CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR)) AS h FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
    n AS (SELECT l_suppkey AS run_id, date_trunc('month', l_shipdate) AS part, sha256(CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR)) AS h FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
    SELECT coalesce(o.run_id, n.run_id) AS run_id, CAST(coalesce(o.part, n.part) AS TIMESTAMP) AS part, o.h AS supersedes, n.h AS content_hash,
      CASE WHEN o.h IS NULL THEN 'ADDED' WHEN n.h IS NULL THEN 'REMOVED' ELSE 'CORRECTED' END AS change
    FROM o FULL JOIN n ON o.run_id = n.run_id AND o.part = n.part WHERE o.h IS DISTINCT FROM n.h""",
)
def content_corrections(spark, folder):
    lines = table(spark, folder, "lineitem")

    def parts(status):
        return (
            lines.filter(F.col("l_linestatus") == status)
            .groupBy(F.col("l_suppkey").alias("run_id"), F.date_trunc("month", "l_shipdate").alias("part"))
            .agg(S.sha256(F.sum(F.col("l_quantity").cast("long")).cast("string")).alias("content_hash"))
        )

    return J.corrections(parts("O"), parts("F"), ["run_id", "part"])


# ---------------------------------------------------------------- intervals


@query(
    "interval_clip",
    f"""WITH {_USER_IV} SELECT event_id, greatest(starts_at, TIMESTAMP '2024-01-10') AS starts_at, least(ends_at, TIMESTAMP '2024-01-20') AS ends_at
    FROM iv WHERE greatest(starts_at, TIMESTAMP '2024-01-10') < least(ends_at, TIMESTAMP '2024-01-20')""",
)
def interval_clip(spark, folder):
    spans = _user_intervals(spark, folder).select("event_id", "starts_at", "ends_at")
    return iv.clip(spans, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))


_MERGE = """m0 AS (SELECT *, max(ends_at) OVER (PARTITION BY {k} ORDER BY starts_at, ends_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
    m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR starts_at > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY starts_at, ends_at ROWS UNBOUNDED PRECEDING) AS island FROM m0),
    {out} AS (SELECT {k}, min(starts_at) AS starts_at, max(ends_at) AS ends_at FROM m1 GROUP BY {k}, island)"""

_IV10 = """iv AS (SELECT user_id, event_type, ts AS starts_at, ts + to_microseconds(CAST(value * 600000000 AS BIGINT)) AS ends_at FROM events)"""


def _long_intervals(spark, folder):
    return table(spark, folder, "events").select(
        "user_id", "event_type", F.col("ts").alias("starts_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 600_000_000).cast("long")).alias("ends_at"),
    )


@query("interval_merge", f"WITH {_IV10}, {_MERGE.format(k='user_id', src='iv', out='m')} SELECT user_id, starts_at, ends_at FROM m")
def interval_merge(spark, folder):
    return iv.coalesce_intervals(_long_intervals(spark, folder), ["user_id"], "day")


@query(
    "interval_gaps",
    f"""WITH {_IV10}, t AS (SELECT user_id, TIMESTAMP '2024-01-05' AS a, TIMESTAMP '2024-01-25' AS b FROM iv GROUP BY 1),
    c AS (SELECT user_id, greatest(starts_at, TIMESTAMP '2024-01-05') AS starts_at, least(ends_at, TIMESTAMP '2024-01-25') AS ends_at FROM iv
          WHERE starts_at < TIMESTAMP '2024-01-25' AND ends_at > TIMESTAMP '2024-01-05'),
    {_MERGE.format(k='user_id', src='c', out='m')},
    g AS (SELECT user_id, ends_at AS starts_at, coalesce(lead(starts_at) OVER (PARTITION BY user_id ORDER BY starts_at), TIMESTAMP '2024-01-25') AS ends_at FROM m
      UNION ALL SELECT t.user_id, t.a, coalesce(min(m.starts_at), t.b) FROM t LEFT JOIN m USING (user_id) GROUP BY t.user_id, t.a, t.b)
    SELECT * FROM g WHERE starts_at < ends_at""",
)
def interval_gaps(spark, folder):
    spans = _long_intervals(spark, folder).select("user_id", "starts_at", "ends_at")
    target = spans.select("user_id").distinct().select(
        "user_id", F.lit("2024-01-05").cast("timestamp").alias("starts_at"), F.lit("2024-01-25").cast("timestamp").alias("ends_at")
    )
    return iv.gaps(target, spans, ["user_id"], "day", points=True)


_IV60 = """iv AS (SELECT user_id, event_type, ts AS starts_at, ts + to_microseconds(CAST(value * 3600000000 AS BIGINT)) AS ends_at FROM events)"""


@query(
    "interval_common",
    f"""WITH {_IV60}, {_MERGE.format(k='user_id, event_type', src='iv', out='m')},
    n AS (SELECT user_id, count(DISTINCT event_type) AS n FROM m GROUP BY 1),
    e AS (SELECT user_id, starts_at AS pt, 1 AS d FROM m UNION ALL SELECT user_id, ends_at, -1 FROM m),
    p AS (SELECT user_id, pt, sum(d) AS d FROM e GROUP BY 1, 2),
    q AS (SELECT user_id, pt, sum(d) OVER (PARTITION BY user_id ORDER BY pt) AS depth, lead(pt) OVER (PARTITION BY user_id ORDER BY pt) AS nxt FROM p),
    f AS (SELECT user_id, pt AS starts_at, nxt AS ends_at FROM q JOIN n USING (user_id) WHERE depth = n AND nxt IS NOT NULL),
    {_MERGE.format(k='user_id', src='f', out='z').replace('m0', 'z0').replace('m1', 'z1')} SELECT user_id, starts_at, ends_at FROM z""",
)
def interval_common(spark, folder):
    """Times at which all event types of a user are active at once."""
    spans = table(spark, folder, "events").select(
        "user_id", "event_type", F.col("ts").alias("starts_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 3_600_000_000).cast("long")).alias("ends_at"),
    )
    sizes = spans.groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))
    return iv.common(spans, ["user_id"], "event_type", sizes, "day")
