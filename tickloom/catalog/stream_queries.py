"""Streaming operators run over a table to the end and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import sql as Q
from tickloom.catalog.base import num, query
from tickloom.catalog.check_queries import _store
from tickloom.catalog.report_queries import _EVAL, _requests
from tickloom.operators import bars as B
from tickloom.operators import detail as D
from tickloom.streaming import ops as T


#: How far the watermark is behind the newest row; rows it has passed, to the millisecond.
LAG = "1 hour"
_PASSED = "epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)"


def _appended(spark, df, partition_by=None):
    path = _store(spark)
    T.run_available(df, f"{path}/out", f"{path}/log", partition_by)
    return spark.read.parquet(f"{path}/out")


@query(
    "stream_bars",
    f"""WITH {Q.TICKS}, b AS (SELECT instrument_id, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS starts_at, arg_min(px, ts) AS open, arg_max(px, ts) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2)
    SELECT instrument_id, starts_at, {Q.num("open")} AS open, {Q.num("close")} AS close, volume FROM b WHERE starts_at + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_bars(spark, folder):
    """Bars of the event stream; bars not yet behind the watermark stay open."""
    ticks, px, qty = B.event_ticks(T.stream_table(spark, folder, "events"))
    done = _appended(spark, T.bars(ticks, ["instrument_id"], "ts", px, qty, "event_id", "30 minutes", "10 minutes"))
    return done.select("instrument_id", "starts_at", num("open").alias("open"), num("close").alias("close"), "volume")


@query(
    "stream_monthly_counters",
    f"""WITH {_EVAL} SELECT run_id, strftime({Q.et("evaluated_at")}, '%Y-%m') AS et_month, count(*) AS evaluation_count, count(*) FILTER (data_gap) AS data_gap_count, count(*) FILTER (trade_occurred) AS triggered_count FROM evl GROUP BY 1, 2""",
)
def stream_monthly_counters(spark, folder):
    evaluations = T.stream_table(spark, folder, "events").select(
        (F.col("user_id") % 20).alias("run_id"), F.col("ts").alias("evaluated_at"), (F.col("event_type") == "purchase").alias("trade_occurred"), (F.col("event_type") == "error").alias("data_gap")
    )
    path = _store(spark)
    T.run_complete(T.monthly_counters(evaluations), f"{path}/out", f"{path}/log")
    return spark.read.parquet(f"{path}/out")


@query(
    "stream_rolling_mean",
    f"""WITH r AS (SELECT user_id, event_id, ts, {Q.num("avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)", 4)} AS rolling_mean FROM events) SELECT user_id, event_id, rolling_mean FROM r WHERE {_PASSED}""",
)
def stream_rolling_mean(spark, folder):
    done = _appended(spark, T.rolling_mean(T.stream_table(spark, folder, "events"), "user_id", "ts", "event_id", "value", 5, LAG))
    return done.select("user_id", "event_id", num("rolling_mean", 4).alias("rolling_mean"))


@query(
    "stream_gate",
    f"""WITH RECURSIVE g AS (SELECT user_id, event_id, ts, value > 10 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), k AS (SELECT * FROM g WHERE c),
    acc(user_id, pos) AS (SELECT user_id, min(pos) FROM k GROUP BY 1 UNION ALL SELECT acc.user_id, min(k.pos) FROM acc JOIN k ON k.user_id = acc.user_id AND k.pos >= acc.pos + 4 GROUP BY acc.user_id, acc.pos)
    SELECT k.user_id, k.event_id FROM acc JOIN k USING (user_id, pos) WHERE {_PASSED}""",
)
def stream_gate(spark, folder):
    events = T.stream_table(spark, folder, "events").withColumn("candidate", F.col("value") > 10)
    return _appended(spark, T.gate(events, "user_id", "ts", "event_id", "candidate", 4, LAG))


@query(
    "stream_message_intake",
    f"""WITH r AS (SELECT event_id AS arrival, ts, CAST(floor(event_id / 3) AS BIGINT) AS message_id, CAST(value * 100 AS BIGINT) % 2 AS h FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts, arrival) AS n, first_value(h) OVER (PARTITION BY message_id ORDER BY ts, arrival) AS fh FROM r)
    SELECT message_id, arrival, CASE WHEN n = 1 THEN 'CLAIMED' WHEN h = fh THEN 'DUPLICATE' ELSE 'CONFLICT' END AS outcome FROM f WHERE {_PASSED}""",
)
def stream_message_intake(spark, folder):
    return _appended(spark, T.classify_messages(_requests(T.stream_table(spark, folder, "events")), "arrived_at", LAG, "30 days"))


@query(
    "stream_sequences",
    f"""WITH rq AS (SELECT event_id AS arrival, ts, user_id % 50 AS aggregate_id, date_diff('second', TIMESTAMP '2024-01-01', ts) - CAST(value * 60 AS BIGINT) AS sequence FROM events),
    s AS (SELECT aggregate_id, arrival, ts, coalesce(sequence <= max(sequence) OVER (PARTITION BY aggregate_id ORDER BY ts, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stale FROM rq)
    SELECT aggregate_id, arrival, stale FROM s WHERE {_PASSED}""",
)
def stream_sequences(spark, folder):
    return _appended(spark, T.classify_sequences(_requests(T.stream_table(spark, folder, "events")), "arrived_at", LAG))


@query("stream_dedupe", "SELECT DISTINCT CAST(floor(event_id / 3) AS BIGINT) AS message_id FROM events")
def stream_dedupe(spark, folder):
    kept = T.dedupe(_requests(T.stream_table(spark, folder, "events")).select("message_id", "arrived_at"), "arrived_at", "1 day", ["message_id"])
    return _appended(spark, kept).select("message_id")


@query(
    "stream_lease_alerts",
    """WITH h AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)
    SELECT user_id, ts AS last_seen FROM h WHERE (n IS NOT NULL AND n - ts > INTERVAL 18 HOUR) OR (n IS NULL AND ts + INTERVAL 18 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events))""",
)
def stream_lease_alerts(spark, folder):
    """Attempts whose lease ran out: heartbeat gaps and keys that fell silent."""
    return _appended(spark, T.lease_alerts(T.stream_table(spark, folder, "events"), "user_id", "ts", "18 hours", "1 hour"))


@query(
    "stream_detail_sink",
    f"SELECT event_type, CAST(date_trunc('week', {Q.et('ts')}) AS DATE) AS week_start, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_detail_sink(spark, folder):
    """Weekly partitions appended by a file sink."""
    rows = D.assign_week(T.stream_table(spark, folder, "events").select("event_id", "event_type", "ts"), "ts")
    stored = _appended(spark, rows, ["week_start"])
    return stored.groupBy("event_type", "week_start").agg(F.count(F.lit(1)).alias("n"))


