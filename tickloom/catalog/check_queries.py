"""Checks, scalars, sources, sinks and plan jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.catalog import sql as Q
from tickloom.catalog.base import ORACLES, money, num, query
from tickloom.catalog.fill_queries import BOOK, CURVE, FIFO, _basis, _booked, _curve, _per_run, _wide
from tickloom.catalog.inputs import FILL_KEYS, FILL_ORDER, calendar, event_bar_events, supplier_days
from tickloom.catalog.report_queries import _COUNTERS, _DETAIL, _EVAL, _detail, _trade_records, monthly_counters, part_manifest
from tickloom.functions import scalars as S
from tickloom.operators import calendar as cal
from tickloom.operators import indicators as I
from tickloom.operators import intervals as iv
from tickloom.operators import ledger as L
from tickloom.operators import monthly as M
from tickloom.operators import quality as V
from tickloom.operators import rules as R
from tickloom.operators import valuation as E
from tickloom.operators import detail as D
from tickloom.plans import compiled as P
from tickloom.schemas import EVENTS
from tickloom.session import cut_lineage, ensure_checkpoint_dir
from tickloom.sources import market, sinks
from tickloom.sources.tables import table

# ---------------------------------------------------------------- checks on tables and bars


@query("schema_check", "SELECT 'venue' AS column_name, 'MISSING' AS finding, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'value', 'NULL_VALUES', n FROM (SELECT count(*) - count(value) AS n FROM events) WHERE n > 0")
def schema_check(spark, folder):
    wanted = T.StructType([T.StructField(f.name, f.dataType, False) for f in EVENTS.fields] + [T.StructField("venue", T.StringType(), False)])
    return V.check_schema(table(spark, folder, "events"), wanted)


@query(
    "row_count_check",
    "SELECT l_suppkey AS object_id, count(*) FILTER (l_tax < 0.08) AS declared, count(*) AS actual FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_tax < 0.08) <> count(*)",
)
def row_count_check(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("object_id"), "l_tax")
    declared = lines.groupBy("object_id").agg(F.count_if(F.col("l_tax") < 0.08).alias("row_count"))
    return V.check_row_counts(lines, declared, ["object_id"])


@query("order_unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def order_unique_check(spark, folder):
    return V.check_order_unique(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("session_date_check", f"SELECT event_id, CAST(ts AS DATE) AS session_date, {Q.et_date('ts')} AS local_date FROM events WHERE {Q.et_date('ts')} <> CAST(ts AS DATE)")
def session_date_check(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts", F.to_date("ts").alias("session_date"))
    return V.check_session_date(rows, "ts", "session_date").select("event_id", "session_date", cal.et_date("ts").alias("local_date"))


@query(
    "period_check",
    """WITH o AS (SELECT event_type, min(ts) + INTERVAL 1 DAY AS s, max(ts) AS e FROM events GROUP BY 1) SELECT event_id FROM events JOIN o USING (event_type) WHERE ts < s OR ts >= e""",
)
def period_check(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    objects = events.groupBy("event_type").agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("period_start"), F.max("ts").alias("period_end"))
    return V.check_period(events, objects, ["event_type"], "ts").select("event_id")


@query(
    "ohlc_check",
    f"""WITH {Q.SUPPLIER_DAYS}, t AS (SELECT * REPLACE (CASE WHEN volume % 2 = 1 THEN open ELSE high END AS high) FROM sbars)
    SELECT instrument_id, starts_at FROM t WHERE high < greatest(open, close) OR low > least(open, close) OR low > high OR least(open, high, low, close) <= 0 OR volume < 0""",
)
def ohlc_check(spark, folder):
    """Bars whose high was replaced by the open on odd volumes."""
    bars = supplier_days(spark, folder)
    broken = bars.withColumn("high", F.when(F.col("volume") % 2 == 1, F.col("open")).otherwise(F.col("high")))
    return V.check_ohlc(broken).select("instrument_id", "starts_at")


@query(
    "span_check",
    f"""WITH {Q.CALENDAR}, {Q.TICKS}, {Q.bars(14400)}, {Q.bar_events("4h", 14400)} SELECT instrument_id, starts_at, ends_at FROM ev WHERE ends_at <> starts_at + INTERVAL 4 HOUR""",
)
def span_check(spark, folder):
    bars = event_bar_events(spark, folder, "4h").withColumn("session_truncated", F.lit(False))
    return V.check_span(bars, 14_400).select("instrument_id", "starts_at", "ends_at")


@query(
    "increasing_check",
    """WITH w AS (SELECT event_id, user_id, date_trunc('hour', ts) AS at, lag(date_trunc('hour', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    SELECT event_id, user_id, CAST(at AS TIMESTAMP) AS hour FROM w WHERE previous >= at""".replace(" AS at,", " AS hr,").replace("CAST(at AS", "CAST(hr AS").replace(">= at", ">= hr"),
)
def increasing_check(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    return V.check_strictly_increasing(rows, ["user_id"], "hour", "event_id", F.date_trunc("month", "hour")).select("event_id", "user_id", "hour")


@query(
    "segment_check",
    """WITH s AS (SELECT user_id, event_id, ts AS starts_at, ts + to_microseconds(CAST(value * 600000000 AS BIGINT)) AS ends_at FROM events),
    w AS (SELECT *, lag(ends_at) OVER (PARTITION BY user_id ORDER BY starts_at, ends_at) AS b FROM s)
    SELECT event_id, user_id, CASE WHEN starts_at < b THEN 'OVERLAP' ELSE 'GAP' END AS finding FROM w WHERE starts_at <> b""",
)
def segment_check(spark, folder):
    from tickloom.catalog.time_queries import _long_intervals

    segments = _long_intervals(spark, folder).join(table(spark, folder, "events").select("user_id", F.col("ts").alias("starts_at"), "event_id"), ["user_id", "starts_at"])
    return V.check_segments(segments, ["user_id"], F.date_trunc("day", "starts_at")).select("event_id", "user_id", "finding")


@query(
    "shard_complete_check",
    f"""WITH o AS (SELECT {Q.et_date("ts")} AS day, user_id % 16 AS shard, event_type FROM events GROUP BY ALL),
    d AS (SELECT DISTINCT day FROM o), w AS (SELECT day, CAST(s AS INTEGER) AS shard FROM d, range(16) r(s)), h AS (SELECT day, shard, count(*) AS n FROM o GROUP BY 1, 2)
    SELECT w.day, w.shard, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'DUPLICATE' END AS finding FROM w LEFT JOIN h ON h.day = w.day AND h.shard = w.shard WHERE n IS NULL OR n > 1""",
)
def shard_complete_check(spark, folder):
    objects = table(spark, folder, "events").select(
        cal.et_date("ts").alias("day"), (F.col("user_id") % 16).alias("shard"), "event_type"
    ).distinct()
    return V.check_shard_complete(objects, ["day"], 16)


@query(
    "session_cover_check",
    f"""WITH {Q.CALENDAR}, c AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
    SELECT user_id, session_date FROM c JOIN ses ON opens_at < TIMESTAMP '2024-01-31' AND closes_at > TIMESTAMP '2024-01-02' WHERE opens_at < a OR closes_at > b""",
)
def session_cover_check(spark, folder):
    cover = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("covered_from"), F.max("ts").alias("covered_through")).select(
        "*", F.lit("2024-01-02").cast("timestamp").alias("window_start"), F.lit("2024-01-31").cast("timestamp").alias("window_end")
    )
    return V.check_sessions_covered(cover, calendar(spark), ["user_id"])


@query(
    "readable_manifests",
    """WITH p AS (SELECT c_custkey, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS s, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 + 700 AS INTEGER)) AS e FROM customer)
    SELECT o_orderkey AS manifest_id, CASE WHEN o_orderstatus <> 'F' THEN 'NOT_AVAILABLE' WHEN o_orderpriority = '5-LOW' THEN 'SCHEMA_MISMATCH'
      WHEN NOT (o_orderdate < e AND s < o_orderdate + INTERVAL 30 DAY) THEN 'PERIOD_OUTSIDE_POLICY' END AS reason_code FROM orders JOIN p ON c_custkey = o_custkey""",
)
def readable_manifests(spark, folder):
    day0 = F.lit("1995-01-01").cast("date")
    offset = (F.col("c_custkey") % 2000).cast("int")
    policies = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("policy_id"), F.date_add(day0, offset).cast("timestamp").alias("policy_start"), F.date_add(day0, offset + 700).cast("timestamp").alias("policy_end")
    )
    manifests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("manifest_id"), F.col("o_custkey").alias("policy_id"), F.when(F.col("o_orderstatus") == "F", "AVAILABLE").otherwise("STAGED").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "v1").otherwise("v2").alias("schema_id"), F.col("o_orderdate").alias("period_start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("period_end"),
    )
    return V.readable_manifests(manifests, policies, "v2").select("manifest_id", "reason_code")


@query(
    "event_check",
    f"""WITH {Q.CALENDAR}, e AS (SELECT CAST(floor(event_id / 1.1) AS BIGINT) AS event_id, event_id AS row_id, ts AS occurred_at, CASE WHEN value < 3 THEN ts - INTERVAL 1 SECOND ELSE date_trunc('hour', ts) + INTERVAL 2 HOUR END AS available_at,
      user_id AS source_sequence, event_type FROM events),
    i AS (SELECT event_id, count(*) AS n FROM e GROUP BY 1), s AS (SELECT available_at, source_sequence, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT e.row_id, CASE WHEN i.n > 1 THEN 'DUPLICATE_ID' WHEN e.available_at < occurred_at THEN 'AVAILABLE_BEFORE_OCCURRED' WHEN s.n > 1 THEN 'DUPLICATE_POSITION' ELSE 'OUTSIDE_SESSION' END AS finding
    FROM e JOIN i USING (event_id) JOIN s ON s.available_at = e.available_at AND s.source_sequence = e.source_sequence LEFT JOIN cal c ON c.session_date = {Q.et_date("e.occurred_at")}
    WHERE i.n > 1 OR e.available_at < occurred_at OR s.n > 1 OR NOT coalesce(occurred_at >= opens_at AND occurred_at < closes_at, FALSE)""",
)
def event_check(spark, folder):
    events = table(spark, folder, "events").select(
        F.floor(F.col("event_id") / F.lit(1.1)).cast("long").alias("event_id"), F.col("event_id").alias("row_id"), F.col("ts").alias("occurred_at"),
        F.when(F.col("value") < 3, F.col("ts") - F.expr("INTERVAL 1 SECOND")).otherwise(F.date_trunc("hour", "ts") + F.expr("INTERVAL 2 HOURS")).alias("available_at"),
        F.col("user_id").alias("source_sequence"), "event_type",
    )
    return V.check_events(events, calendar(spark)).select("row_id", "finding")


@query(
    "feature_pin_check",
    """WITH r AS (SELECT o_orderkey AS feature_id, o_custkey, o_orderdate FROM orders), m AS (SELECT l_orderkey, max(l_returnflag) AS f, max(l_linestatus) AS s, min(l_shipdate) AS a, max(l_shipdate) AS b, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT feature_id, CASE WHEN m.l_orderkey IS NULL THEN 'MATERIALISATION_MISSING' WHEN f = 'N' THEN 'NOT_SUCCEEDED' WHEN n % 5 = 0 THEN 'DEFINITION_MISMATCH' WHEN n % 7 = 0 THEN 'VERSION_MISMATCH' WHEN s = 'F' THEN 'RESOLUTION_MISMATCH'
      WHEN a > o_orderdate + INTERVAL 60 DAY OR b < o_orderdate + INTERVAL 90 DAY THEN 'WINDOW_NOT_COVERED' END AS reason_code FROM r LEFT JOIN m ON m.l_orderkey = feature_id""",
)
def feature_pin_check(spark, folder):
    required = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("feature_id"), F.lit("RSI_14").alias("definition"), F.lit(1).alias("version"), F.lit("30m").alias("resolution"), F.lit("h").alias("result_hash"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("window_start"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("window_end"),
    )
    n = F.max("l_linenumber")
    made = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("feature_id")).agg(
        F.when(F.max("l_returnflag") == "N", "FAILED").otherwise("SUCCEEDED").alias("status"), F.when(n % 5 == 0, "RSI_9").otherwise("RSI_14").alias("definition"),
        F.when(n % 7 == 0, 2).otherwise(1).alias("version"), F.when(F.max("l_linestatus") == "F", "1h").otherwise("30m").alias("resolution"), F.lit("h").alias("result_hash"),
        F.min("l_shipdate").alias("period_start"), F.max("l_shipdate").alias("period_end"),
    )
    return V.check_feature_pins(required, made, ["feature_id"]).select("feature_id", "reason_code")


# ---------------------------------------------------------------- checks on derived tables


@query("part_check", f"WITH {BOOK}, {_DETAIL}, w AS (SELECT run_id, record_type, week_start, max(part) AS n FROM pm GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS intact, CAST(sum(n - 1) AS BIGINT) AS after_drop FROM w")
def part_check(spark, folder):
    """Manifests of the detail parts pass; without the first part of each week every later part is misnumbered."""
    parts = cut_lineage(part_manifest(spark, folder))
    keys = ["run_id", "record_type", "week_start"]
    block = F.floor(F.col("part") / 1_000)
    intact = V.check_parts(parts, keys, block).agg(F.count(F.lit(1)).alias("intact"))
    dropped = V.check_parts(parts.filter("part <> 1"), keys, block).select(F.count(F.lit(1))).scalar()
    return intact.withColumn("after_drop", dropped)


@query("detail_row_check", f"WITH {BOOK}, {_DETAIL} SELECT run_id, record_type, week_start, part, 'ROW_COUNT' AS finding FROM pm WHERE run_id % 5 = 0")
def detail_row_check(spark, folder):
    """Manifests of every fifth run state a row too many."""

    def findings(log, whole):
        rows = _detail(log, whole).select("run_id", "record_type", "week_start", "part", "occurred_at", "record_id")
        rows = rows if whole else cut_lineage(rows)
        parts = D.part_manifest(rows, "occurred_at", "record_id")
        stated = parts.withColumn("row_count", F.col("row_count") + F.when(F.col("run_id") % 5 == 0, 1).otherwise(0))
        return V.check_detail_rows(rows, stated, ["run_id", "record_type", "week_start", "part"], "occurred_at")

    return _per_run(spark, folder, findings)


@query("balance_check", f"WITH {BOOK} SELECT run_id, instrument_id, order_id, line_no, part_id, '1.00000000' AS imbalance FROM bk WHERE order_id % 50 = 0 AND fee <> 0")
def balance_check(spark, folder):
    """A ledger in which some fees were booked one too high: exactly those transactions are out of balance."""
    ids = ["run_id", "instrument_id", "order_id", "line_no", "part_id", "occurred_at"]
    wrong = (F.col("account") == "FEE") & (F.col("order_id") % 50 == 0)
    amount = F.when(wrong, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(24,8)")
    bad = _per_run(spark, folder, lambda log, whole: V.check_balanced(L.ledger_entries(_basis(log, whole), ids).withColumn("amount", amount), ids))
    return bad.select(*ids[:-1], money("imbalance").alias("imbalance"))


@query(
    "fill_arithmetic_check",
    """SELECT event_id FROM (SELECT event_id, CAST(value AS DECIMAL(18,8)) AS p, CAST(user_id AS DECIMAL(28,8)) AS q, CAST(round(value) AS DECIMAL(18,8)) AS r FROM events)
    WHERE round_even(p * q, 8) <> round_even(r * q, 8)""",
)
def fill_arithmetic_check(spark, folder):
    """Fills whose gross amount was computed from a rounded price."""
    rows = table(spark, folder, "events").select("event_id", S.price("value").alias("price"), F.col("user_id").cast("decimal(18,8)").alias("quantity"), F.round("value").alias("r"))
    staged = rows.withColumns(
        {"base_price": F.col("price"), "slippage_amount": F.lit(0).cast("decimal(24,8)"), "gross_amount": F.bround(S.price("r") * F.col("quantity"), 8)}
    )
    return V.check_fill_arithmetic(staged).select("event_id")


@query("position_delta_check", f"WITH {BOOK} SELECT run_id, instrument_id, order_id, line_no, part_id FROM bk WHERE order_id % 50 = 0")
def position_delta_check(spark, folder):
    """Fills whose executed quantity was altered afterwards no longer explain the move of their position."""
    altered = _booked(spark, folder).withColumn("executed", (F.col("executed") + F.when(F.col("order_id") % 50 == 0, 1).otherwise(0)).cast("decimal(18,8)"))
    return V.check_position_deltas(altered, FILL_KEYS, FILL_ORDER, F.date_trunc("month", "occurred_at")).select("run_id", "instrument_id", "order_id", "line_no", "part_id")


@query(
    "month_id_check",
    f"WITH {_EVAL} SELECT run_id, strftime({Q.et('occurred_at')}, '%Y-%m') AS et_month, record_id, 'ONLY_STORED' AS finding FROM rec WHERE kind = 'REJECTION'",
)
def month_id_check(spark, folder):
    """Stored trades against a list without its rejections."""
    records = _trade_records(spark, folder)
    stored = M.monthly_trade_ids(records)
    listed = M.monthly_trade_ids(records.filter("kind <> 'REJECTION'"))
    return V.check_month_ids(stored, listed)


@query(
    "metric_set_check",
    "SELECT l_suppkey AS run_id, k AS metric_key, CASE WHEN k = 'alpha' THEN 'UNKNOWN' ELSE 'MISSING' END AS finding FROM (SELECT DISTINCT l_suppkey FROM lineitem), (VALUES ('alpha'), ('sharpe')) v(k)",
)
def metric_set_check(spark, folder):
    """Metrics with one key renamed: one missing and one unknown finding per run."""
    metrics = E.metrics_long(_wide(spark, folder)).withColumn("metric_key", F.when(F.col("metric_key") == "sharpe", "alpha").otherwise(F.col("metric_key")))
    return V.check_metric_set(cut_lineage(metrics), [(k, u) for k, u, _ in E.METRIC_CATALOGUE])


@query("equity_check", f"WITH {FIFO}, {CURVE} SELECT run_id, as_of, 'SUM' AS finding FROM cv WHERE day(as_of) % 7 = 0")
def equity_check(spark, folder):
    """Curve points that were raised by one are not the sum of cash and positions."""

    def findings(log, whole):
        raised = _curve(log, whole).withColumn("equity", (F.col("equity") + F.when(F.dayofmonth("as_of") % 7 == 0, 1).otherwise(0)).cast("decimal(24,8)"))
        return V.check_equity(raised if whole else cut_lineage(raised), "as_of", None if whole else F.date_trunc("month", "as_of"))

    return _per_run(spark, folder, findings).select("run_id", "as_of", "finding")


@query("counter_check", f"SELECT run_id, et_month FROM ({ORACLES['monthly_counters']}) WHERE run_id % 5 = 0")
def counter_check(spark, folder):
    """Summaries of every fifth run claim more triggers than evaluations."""
    claimed = F.col("triggered_count") + F.when(F.col("run_id") % 5 == 0, F.col("evaluation_count") + 1).otherwise(0)
    return V.check_summary_counters(monthly_counters(spark, folder).withColumn("triggered_count", claimed)).select("run_id", "et_month")


# ---------------------------------------------------------------- scalars


@query(
    "money_scalars",
    f"""SELECT event_id, {Q.money("round_even(CAST(value AS DECIMAL(28,12)) * CAST('0.12345678' AS DECIMAL(9,8)), 8)")} AS rated, {Q.money("CAST(value AS DECIMAL(18,8))")} AS money,
      {Q.num("round_even(CAST(value AS DECIMAL(18,8)), 0)")} AS whole, {Q.num("floor(CAST(value AS DECIMAL(18,8)) / 5) * 5")} AS floored,
      rtrim(rtrim(CAST(CAST(value AS DECIMAL(18,8)) AS VARCHAR), '0'), '.') AS plain, {Q.num("value * 100 / (user_id + 1)")} AS pct FROM events""",
)
def money_scalars(spark, folder):
    value = S.price("value")
    return table(spark, folder, "events").select(
        "event_id",
        S.format_money(S.apply_rate(value, F.lit("0.12345678").cast("decimal(9,8)"))).alias("rated"),
        S.format_money(S.quantize_money(value)).alias("money"),
        num(S.quantize_quantity(value, False)).alias("whole"),
        num(S.floor_to_quantum(value, F.lit(5).cast("decimal(9,8)"))).alias("floored"),
        S.plain_text(value).alias("plain"),
        num(S.percent(F.col("value"), (F.col("user_id") + 1).cast("double"))).alias("pct"),
    )


@query(
    "text_scalars",
    """SELECT event_id, sha256(event_type || event_id) AS digest, 'sha256:' || sha256(event_type) AS prefixed, sha256(event_type) AS stripped,
      CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso,
      sha256('event_type=' || event_type || chr(10) || 'user_id=' || user_id) AS fingerprint, CASE user_id % 4 WHEN 0 THEN 'PT30M' WHEN 1 THEN 'PT1H' WHEN 2 THEN 'PT4H' ELSE 'P1D' END AS iso_duration,
      CAST(CASE user_id % 4 WHEN 0 THEN 1800 WHEN 1 THEN 3600 WHEN 2 THEN 14400 ELSE 86400 END AS INTEGER) AS seconds,
      regexp_full_match(event_type || '-x', '[0-9a-f-]{36}') AS is_uuid, CAST(json_object('event_type', event_type, 'user_id', user_id) AS VARCHAR) AS canonical FROM events""",
)
def text_scalars(spark, folder):
    token = F.element_at(F.array(F.lit("30m"), F.lit("1h"), F.lit("4h"), F.lit("1d")), (F.col("user_id") % 4 + 1).cast("int"))
    prefixed = S.with_hash_prefix(S.sha256("event_type"))
    return table(spark, folder, "events").select(
        "event_id",
        S.sha256(F.concat("event_type", F.col("event_id").cast("string"))).alias("digest"),
        prefixed.alias("prefixed"),
        S.strip_hash_prefix(prefixed).alias("stripped"),
        S.utc_text("ts").alias("iso"),
        S.input_fingerprint({"event_type": "event_type", "user_id": "user_id"}).alias("fingerprint"),
        S.token_to_iso(token).alias("iso_duration"),
        S.token_to_seconds(S.iso_to_token(S.token_to_iso(token))).alias("seconds"),
        S.is_uuid(F.concat("event_type", F.lit("-x"))).alias("is_uuid"),
        S.canonical_json({"user_id": "user_id", "event_type": "event_type"}).alias("canonical"),
    )


@query(
    "name_uuids",
    f"""WITH h AS (SELECT event_id, sha1(unhex('{S.UUID_NAMESPACE_URL.replace("-", "")}') || ('event:' || event_id)::BLOB) AS h FROM events)
    SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INTEGER % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""",
)
def name_uuids(spark, folder):
    return table(spark, folder, "events").select("event_id", S.uuid5(F.concat_ws(":", F.lit("event"), F.col("event_id").cast("string"))).alias("id"))


@query("price_changes", """WITH e AS (SELECT event_id, CAST(value AS DECIMAL(18,8)) AS c, CAST(user_id % 5 AS DECIMAL(18,8)) AS b FROM events)
    SELECT event_id, CASE WHEN b <> 0 THEN round(CAST(c - b AS DOUBLE) * 100 / CAST(b AS DOUBLE), 6) END AS change, CASE WHEN b = 0 THEN 'ZERO_BASE' ELSE 'OK' END AS status FROM e""")
def price_changes(spark, folder):
    rows = table(spark, folder, "events").select("event_id", S.price("value").alias("close"), (F.col("user_id") % 5).cast("decimal(18,8)").alias("base"))
    return I.pct_change("base")(rows).select("event_id", num("pct_base").alias("change"), F.col("pct_base_status").alias("status"))


@query("sorted_instruments", "SELECT l_orderkey AS order_id, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS instruments FROM lineitem GROUP BY 1")
def sorted_instruments(spark, folder):
    """Suppliers of each order, sorted and without repeats (an order has a handful of lines)."""
    listed = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list("l_suppkey").alias("listed"))
    return listed.select("order_id", F.array_join(S.sorted_unique("listed").cast("array<string>"), ",").alias("instruments"))


@query(
    "week_month_overlap",
    f"""WITH w AS (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m') AS month FROM lineitem)
    SELECT week, month, week <= last_day(CAST(month || '-01' AS DATE)) AND week + INTERVAL 6 DAY >= CAST(month || '-01' AS DATE) AS touches FROM w""",
)
def week_month_overlap(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"), F.date_format(F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM").alias("month")
    ).distinct()
    return rows.select("week", "month", S.week_overlaps_month(F.col("week"), F.col("month")).alias("touches"))


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08)
    SELECT 'except' AS op, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""",
)
def set_operations(spark, folder):
    lines = table(spark, folder, "lineitem")
    a = lines.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct()
    b = lines.filter("l_discount > 0.08").select(F.col("l_partkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").select(F.lit("except").alias("op"), "k").unionByName(a.join(b, "k", "left_semi").select(F.lit("intersect").alias("op"), "k"))


# ---------------------------------------------------------------- rule tables, availability


@query(
    "rule_lookbacks",
    """WITH s AS (SELECT p_partkey AS step_id, p_partkey // 3 AS plan_id, CASE p_partkey % 5 WHEN 0 THEN 'SMA_CROSS' WHEN 1 THEN 'STREAK' WHEN 2 THEN 'PRICE_COMPARE' WHEN 3 THEN 'VOLUME_COMPARE' ELSE 'MACD_CROSS' END AS op, p_size AS n FROM part),
    l AS (SELECT *, CASE op WHEN 'SMA_CROSS' THEN n * 2 + 1 WHEN 'STREAK' THEN n + 1 WHEN 'PRICE_COMPARE' THEN n + 1 WHEN 'VOLUME_COMPARE' THEN n + 1 ELSE n * 2 + n + 2 END AS lookback FROM s)
    SELECT plan_id, CAST(CASE WHEN bool_or(op = 'MACD_CROSS') THEN 180 ELSE least(180, max(lookback)) END AS INTEGER) AS visible_bars, CAST(max(lookback) AS INTEGER) AS longest FROM l GROUP BY 1""",
)
def rule_lookbacks(spark, folder):
    i = (F.col("p_partkey") % 5 + 1).cast("int")
    ops = F.array(*[F.lit(x) for x in ("SMA_CROSS", "STREAK", "PRICE_COMPARE", "VOLUME_COMPARE", "MACD_CROSS")])
    steps = table(spark, folder, "part").select(F.floor(F.col("p_partkey") / 3).alias("plan_id"), F.element_at(ops, i).alias("operation"), F.col("p_size").alias("n"))
    ref = F.when(F.col("operation") == "PRICE_COMPARE", F.concat(F.lit("HIGH_"), F.col("n").cast("string"))).otherwise("AVERAGE_VOLUME")
    staged = steps.withColumn("lookback", I.lookback(F.col("operation"), ref, F.col("n"), F.col("n") * 2))
    limits = I.visible_limit(staged)
    return limits.join(staged.groupBy("plan_id").agg(F.max("lookback").alias("longest")), "plan_id")


@query(
    "series_requirements",
    """SELECT 'S' || l_suppkey AS instrument_id, CASE l_linenumber % 2 WHEN 0 THEN '1d' ELSE '1h' END AS resolution, min(l_shipdate - to_seconds(CAST(l_quantity AS BIGINT) * CASE l_linenumber % 2 WHEN 0 THEN 86400 ELSE 3600 END)) AS warmup_from, CAST(max(l_quantity) AS INTEGER) AS bars
    FROM lineitem GROUP BY 1, 2""",
)
def series_requirements(spark, folder):
    rules = table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("instrument_id"), F.lit("BAR").alias("data_kind"), F.when(F.col("l_linenumber") % 2 == 0, "1d").otherwise("1h").alias("resolution"),
        F.col("l_shipdate").alias("period_start"), F.col("l_quantity").cast("int").alias("lookback"),
    ).withColumn("period_seconds", S.token_to_seconds("resolution"))
    return R.requirements(rules).drop("data_kind")


@query(
    "flow_clocks",
    """WITH f AS (SELECT l_orderkey AS flow_id, l_partkey AS instrument_id, CASE WHEN l_orderkey % 20 = 0 THEN CASE l_linenumber % 2 WHEN 0 THEN '30m' ELSE '1h' END END AS resolution FROM lineitem),
    o AS (SELECT DISTINCT instrument_id, resolution FROM f WHERE resolution IS NOT NULL), n AS (SELECT DISTINCT flow_id, instrument_id FROM f WHERE resolution IS NULL)
    SELECT flow_id, CASE WHEN count(DISTINCT resolution) = 1 THEN min(resolution) END AS resolution, CASE count(DISTINCT resolution) WHEN 1 THEN 'INHERITED' WHEN 0 THEN 'NO_CLOCK' ELSE 'AMBIGUOUS' END AS finding
    FROM n LEFT JOIN o USING (instrument_id) GROUP BY 1""",
)
def flow_clocks(spark, folder):
    # Flows whose number is a multiple of twenty own a clock, the others inherit one.
    own = F.col("l_orderkey") % 20 == 0
    clock = F.when(F.col("l_linenumber") % 2 == 0, "30m").otherwise("1h")
    return R.resolve_flow_clock(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("flow_id"), F.col("l_partkey").alias("instrument_id"), F.when(own, clock).alias("resolution")))


@query(
    "coverage_by_scope",
    """WITH c AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2) SELECT event_type, max(a) AS covered_from, min(b) AS covered_through FROM c GROUP BY 1""",
)
def coverage_by_scope(spark, folder):
    objects = table(spark, folder, "events").select("user_id", "event_type", F.col("ts").alias("period_start"), F.col("ts").alias("period_end"))
    return iv.common_coverage(iv.coverage(objects, ["user_id", "event_type"]), ["event_type"])


@query(
    "evaluation_windows",
    """SELECT o_orderkey AS run_id, o_orderdate + to_seconds(CAST(o_custkey % 40 * 86400 AS BIGINT)) AS evaluation_from, CASE WHEN o_custkey % 40 < 30 THEN 'OK' ELSE 'UNAVAILABLE' END AS window_status FROM orders""",
)
def evaluation_windows(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("period_start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("period_end"), (F.col("o_custkey") % 40 * 86_400).alias("warmup_seconds")
    )
    return iv.evaluation_window(runs).select("run_id", "evaluation_from", "window_status")


_AV = """
rq AS (SELECT user_id || ':' || event_type AS requirement_id, user_id AS run_id, event_type AS instrument_id, TIMESTAMP '2024-01-03' AS warmup_from, TIMESTAMP '2024-01-06' AS evaluation_from, TIMESTAMP '2024-01-26' AS evaluation_through FROM (SELECT DISTINCT user_id, event_type FROM events)),
ob AS (SELECT user_id || ':' || event_type AS requirement_id, CASE WHEN user_id % 11 = 3 THEN 'other' ELSE event_type END AS instrument_id, user_id % 13 <> 5 AS verified, CASE WHEN user_id % 17 = 2 THEN TIMESTAMP '2024-01-10' END AS listed_at FROM events WHERE user_id % 7 <> 6 GROUP BY user_id, event_type),
iv AS (SELECT user_id || ':' || event_type AS requirement_id, ts - INTERVAL 30 HOUR AS starts_at, ts + to_microseconds(CAST(value * 7200000000 AS BIGINT)) AS ends_at FROM events),
cl AS (SELECT iv.requirement_id, greatest(starts_at, warmup_from) AS starts_at, least(ends_at, evaluation_through) AS ends_at FROM iv JOIN rq USING (requirement_id) WHERE starts_at < evaluation_through AND ends_at > warmup_from),
g0 AS (SELECT *, max(ends_at) OVER (PARTITION BY requirement_id ORDER BY starts_at, ends_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cl),
gp AS (SELECT requirement_id, reach AS s, starts_at AS e FROM g0 WHERE starts_at > reach UNION ALL SELECT requirement_id, warmup_from, min(cl.starts_at) FROM rq JOIN cl USING (requirement_id) GROUP BY 1, 2 UNION ALL SELECT requirement_id, max(cl.ends_at), evaluation_through FROM rq JOIN cl USING (requirement_id) GROUP BY 1, 3),
gq AS (SELECT * FROM gp WHERE s < e),
asx AS (SELECT rq.*, CASE WHEN ob.requirement_id IS NULL THEN 'OBSERVATION_MISSING' WHEN ob.instrument_id <> rq.instrument_id THEN 'SERIES_IDENTITY_MISMATCH' WHEN NOT verified THEN 'SERIES_UNVERIFIED' WHEN listed_at > evaluation_from THEN 'INSTRUMENT_LISTED_AFTER_EVALUATION_START'
  WHEN NOT EXISTS (SELECT 1 FROM cl WHERE cl.requirement_id = rq.requirement_id) THEN 'REQUIRED_SERIES_ABSENT' WHEN EXISTS (SELECT 1 FROM gq WHERE gq.requirement_id = rq.requirement_id AND gq.s < evaluation_from) THEN 'WARMUP_COVERAGE_MISSING'
  WHEN NOT EXISTS (SELECT 1 FROM cl WHERE cl.requirement_id = rq.requirement_id AND cl.ends_at > evaluation_from) THEN 'EVALUATION_COVERAGE_ABSENT' END AS reason_code FROM rq LEFT JOIN ob USING (requirement_id))
"""


def _availability(spark, folder):
    events = table(spark, folder, "events")
    rid = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    kinds = events.select("user_id", "event_type").distinct()
    day = lambda d: F.lit(d).cast("timestamp")
    required = kinds.select(
        rid.alias("requirement_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("instrument_id"), F.lit("BAR").alias("data_kind"), F.lit("30m").alias("resolution"),
        day("2024-01-03").alias("warmup_from"), day("2024-01-06").alias("evaluation_from"), day("2024-01-26").alias("evaluation_through"),
    )
    observed = kinds.filter("user_id % 7 <> 6").select(
        rid.alias("requirement_id"), F.when(F.col("user_id") % 11 == 3, "other").otherwise(F.col("event_type")).alias("instrument_id"), F.lit("BAR").alias("data_kind"), F.lit("30m").alias("resolution"),
        (F.col("user_id") % 13 != 5).alias("verified"), F.when(F.col("user_id") % 17 == 2, day("2024-01-10")).alias("listed_at"),
    )
    spans = events.select(
        rid.alias("requirement_id"), (F.col("ts") - F.expr("INTERVAL 30 HOURS")).alias("starts_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 7_200_000_000).cast("long")).alias("ends_at"),
    )
    assessed = cut_lineage(iv.assess_requirements(required, observed, spans))
    return assessed, spans


@query("requirement_assessment", f"WITH {_AV} SELECT requirement_id, reason_code FROM asx")
def requirement_assessment(spark, folder):
    """First reason per data requirement in fixed order."""
    assessed, _ = _availability(spark, folder)
    return assessed.select("requirement_id", "reason_code")


@query(
    "skip_intervals",
    f"""WITH {_AV} SELECT requirement_id, greatest(s, evaluation_from) AS starts_at, e AS ends_at FROM gq JOIN asx USING (requirement_id) WHERE reason_code IS NULL AND e > evaluation_from""",
)
def skip_intervals(spark, folder):
    assessed, spans = _availability(spark, folder)
    return iv.skip_intervals(assessed.filter("reason_code IS NULL"), spans)


@query(
    "run_assessment",
    f"""WITH {_AV}, mm AS (SELECT requirement_id, greatest(starts_at, evaluation_from) AS s, ends_at AS e FROM cl JOIN asx USING (requirement_id) WHERE reason_code IS NULL AND ends_at > evaluation_from),
    pt AS (SELECT DISTINCT run_id, s AS t FROM mm JOIN asx USING (requirement_id)),
    cm AS (SELECT pt.run_id, pt.t FROM pt JOIN asx a ON a.run_id = pt.run_id GROUP BY 1, 2 HAVING count(*) = count(*) FILTER (EXISTS (SELECT 1 FROM mm WHERE mm.requirement_id = a.requirement_id AND mm.s <= pt.t AND pt.t < mm.e))),
    sk AS (SELECT DISTINCT run_id FROM gq JOIN asx USING (requirement_id) WHERE reason_code IS NULL AND e > evaluation_from),
    r AS (SELECT run_id, count(reason_code) AS missing, count(DISTINCT reason_code) AS kinds, min(reason_code) AS reason FROM asx GROUP BY 1)
    SELECT r.run_id, CASE WHEN missing > 0 OR r.run_id NOT IN (SELECT run_id FROM cm) THEN 'UNAVAILABLE' WHEN r.run_id IN (SELECT run_id FROM sk) THEN 'DEGRADED' ELSE 'AVAILABLE' END AS status,
      CASE WHEN kinds = 1 THEN reason WHEN kinds > 1 THEN 'REQUIRED_DATA_UNAVAILABLE' WHEN r.run_id NOT IN (SELECT run_id FROM cm) THEN 'NO_COMMON_REPLAYABLE_INTERVAL' END AS reason_code FROM r""".replace(
        "count(*) FILTER (EXISTS (SELECT 1 FROM mm WHERE mm.requirement_id = a.requirement_id AND mm.s <= pt.t AND pt.t < mm.e))",
        "count(DISTINCT CASE WHEN mm.requirement_id IS NOT NULL THEN a.requirement_id END)",
    ).replace("JOIN asx a ON a.run_id = pt.run_id GROUP BY 1, 2 HAVING count(*) =", "JOIN asx a ON a.run_id = pt.run_id LEFT JOIN mm ON mm.requirement_id = a.requirement_id AND mm.s <= pt.t AND pt.t < mm.e GROUP BY 1, 2 HAVING count(DISTINCT a.requirement_id) ="),
)
def run_assessment(spark, folder):
    """AVAILABLE, DEGRADED or UNAVAILABLE per run."""
    assessed, spans = _availability(spark, folder)
    skips = iv.skip_intervals(assessed.filter("reason_code IS NULL"), spans)
    return iv.assess_runs(assessed, spans, cut_lineage(skips))


@query(
    "unavailable_requirements",
    f"""WITH {_AV}, m AS (SELECT run_id, requirement_id || ':' || reason_code AS missing_requirement, reason_code FROM asx WHERE reason_code IS NOT NULL),
    k AS (SELECT run_id, CASE WHEN count(DISTINCT reason_code) = 1 THEN min(reason_code) ELSE 'REQUIRED_DATA_UNAVAILABLE' END AS reason_code FROM m GROUP BY 1)
    SELECT run_id, k.reason_code, row_number() OVER (PARTITION BY run_id ORDER BY missing_requirement) AS ordinal, missing_requirement FROM m JOIN k USING (run_id)""",
)
def unavailable_requirements(spark, folder):
    """Missing requirements of every unavailable run, in order, with the reason the run reports."""
    return iv.unavailable_requirements(_availability(spark, folder)[0], prefix=8)


# ---------------------------------------------------------------- sources and sinks


@query(
    "shard_pruning",
    """WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'all' ELSE 's' || lpad(CAST(p_partkey % 64 AS VARCHAR), 2, '0') || '-of-64' END AS shard_key FROM part),
    w AS (SELECT DISTINCT (('0x' || substr(sha256('S' || s_suppkey), 1, 16))::UBIGINT % 64) AS shard FROM supplier)
    SELECT p_partkey AS object_id, shard_key FROM o WHERE shard_key = 'all' OR TRY_CAST(substr(shard_key, 2, 2) AS INTEGER) IN (SELECT shard FROM w)""",
)
def shard_pruning(spark, folder):
    label = F.when(F.col("p_partkey") % 10 == 0, "all").otherwise(market.shard_label((F.col("p_partkey") % 64).cast("int"), F.lit(64)))
    objects = table(spark, folder, "part").select(F.col("p_partkey").alias("object_id"), label.alias("shard_key"))
    wanted = table(spark, folder, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("instrument_id"))
    return market.prune_shards(objects, wanted)


def _store(spark):
    return f"{ensure_checkpoint_dir(spark)}/stores/{uuid.uuid4().hex}"


_MARKET_SQL = f"""WITH {Q.CALENDAR}, {Q.TICKS}, {Q.bars(1800)}"""


def _bar_dataset(spark, folder):
    bars = event_bar_events(spark, folder)
    return bars.select(
        "instrument_id", F.upper("instrument_id").alias("provider_symbol"), F.col("starts_at").alias("bar_start_at"), "session_date_et",
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], "volume",
    )


@query(
    "bar_scan",
    f"""{_MARKET_SQL} SELECT instrument_id, bar_start_at, {Q.num("close")} AS close, volume FROM bars WHERE instrument_id IN ('view', 'click') AND bar_start_at >= TIMESTAMP '2024-01-09' AND bar_start_at < TIMESTAMP '2024-01-20'""",
)
def bar_scan(spark, folder):
    """Bars written as a dataset and read back with pushed-down instrument and period filters."""
    path = _store(spark)
    _bar_dataset(spark, folder).write.parquet(path)
    return market.scan_bars(spark, [path], ["view", "click"], "2024-01-09", "2024-01-20").select("instrument_id", "bar_start_at", num("close").alias("close"), "volume")


@query(
    "partitioned_scan",
    f"""{_MARKET_SQL} SELECT instrument_id, CAST(year(bar_start_at) AS INTEGER) AS year, count(*) AS bars FROM bars WHERE instrument_id <> 'error' GROUP BY 1, 2""",
)
def partitioned_scan(spark, folder):
    path = _store(spark)
    bars = _bar_dataset(spark, folder).withColumn("feed", F.lit("iex")).withColumn("year", F.year("bar_start_at")).withColumn("shard", F.col("instrument_id"))
    bars.write.partitionBy("feed", "year", "shard").parquet(path)
    return market.scan_partitioned(spark, path).filter("feed = 'iex' AND shard <> 'error'").groupBy("instrument_id", "year").agg(F.count(F.lit(1)).alias("bars"))


@query("object_digests", "SELECT DISTINCT event_type AS instrument_id FROM events WHERE event_type = 'view'")
def object_digests(spark, folder):
    """Written objects are re-hashed; one declared hash is wrong and must be found."""
    path = _store(spark)
    _bar_dataset(spark, folder).write.partitionBy("instrument_id").parquet(path)
    actual = market.file_digests(spark, path)
    declared = actual.withColumn("content_hash", F.when(F.col("path").contains("instrument_id=view"), "0").otherwise(F.col("content_hash")))
    return market.digest_mismatches(actual, declared).select(F.regexp_extract("path", r"instrument_id=(\w+)", 1).alias("instrument_id"))


@query(
    "detail_store",
    f"""WITH {_EVAL} SELECT run_id, CAST(date_trunc('week', {Q.et("occurred_at")}) AS DATE) AS week_start, 1 AS part, count(*) AS n, min(occurred_at) AS first_at FROM rec GROUP BY ALL""",
)
def detail_store(spark, folder):
    """Trade records written as weekly detail parts and read back by partition."""
    path = _store(spark)
    trades = D.detail_rows(_trade_records(spark, folder), "TRADE", "occurred_at", ["record_id"], ["kind"])
    sinks.write_detail(D.number_parts(D.assign_week(trades, "occurred_at"), "occurred_at", ["record_id"]), path)
    stored = spark.read.parquet(path).filter("record_type = 'TRADE'")
    return stored.groupBy("run_id", "week_start", "part").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first_at"))


@query("result_json", f"WITH {_EVAL} SELECT run_id, count(*) AS lines FROM rec GROUP BY 1")
def result_json(spark, folder):
    """Trade records of every run as canonical JSON lines, read back as text."""
    path = _store(spark)
    sinks.write_results_json(_trade_records(spark, folder), path)
    return spark.read.text(path).groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count(F.lit(1)).alias("lines"))


@query("summary_store", f"WITH {_EVAL}, {_COUNTERS} SELECT run_id, count(*) AS months, CAST(sum(evaluation_count) AS BIGINT) AS evaluations FROM mc GROUP BY 1")
def summary_store(spark, folder):
    """Summary tables replaced per run: the second write of the same runs leaves one copy."""
    path = _store(spark)
    counters = cut_lineage(monthly_counters(spark, folder))
    for _ in range(2):
        sinks.write_summaries({"monthly": counters}, path)
    stored = spark.read.parquet(f"{path}/monthly")
    return stored.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count(F.lit(1)).alias("months"), F.sum("evaluation_count").alias("evaluations"))


@query(
    "manifest_join",
    """SELECT s_suppkey AS feed_id, n_name AS provider, count(*) AS objects, min(l_shipdate) AS period_start, max(l_shipdate) AS period_end FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1, 2""",
)
def manifest_join(spark, folder):
    lineage = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    objects = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("feed_id"), "l_shipdate").join(lineage, "l_orderkey", "left_semi")
    per_feed = objects.groupBy("feed_id").agg(F.count(F.lit(1)).alias("objects"), F.min("l_shipdate").alias("period_start"), F.max("l_shipdate").alias("period_end"))
    feeds = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("feed_id"), F.col("n_name").alias("provider"))
    return per_feed.join(feeds, "feed_id")


# ---------------------------------------------------------------- plans


def _plans(spark, folder):
    """One compiled plan per part row, every fourth of version 1; some plans carry the faults the lint looks for."""
    size = F.col("p_size").cast("string")
    key = F.col("p_partkey").cast("string")
    number = F.col("p_partkey")

    def step(seq, op, **args):
        pairs = [x for k, v in args.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))]
        return F.struct((F.lit(seq) if isinstance(seq, int) else seq).alias("sequence"), F.lit(op).alias("operation"), F.create_map(*pairs).alias("arguments"))

    first = number % 4 == 0
    shared = F.array(
        step(1, "LOAD_FEATURE", feature="RSI_14", resolution="1m"),
        step(2, "COMPARE", operator=F.when(number % 5 == 0, "BELOW").otherwise("LT"), threshold=size),
        step(3, "EMIT_ORDER_CANDIDATE", allocation="EQUAL", orderType="MARKET", side="BUY"),
    )
    per_flow = F.array(
        step(1, "SMA_CROSS", direction="UP", shortPeriod="5", longPeriod=F.when(number % 9 == 0, "45").otherwise("60"), resolution="1d"),
        step(2, "RSI_CROSS", direction=F.when(number % 7 == 0, "SIDEWAYS").otherwise("UP"), period="14", threshold=(F.col("p_size") * 3).cast("string"), resolution="1d"),
        step(
            F.when(number % 11 == 0, 4).otherwise(3), "EMIT_ORDER_CANDIDATE", allocation="EQUAL", orderType="MARKET", timeInForce="DAY", side="BUY", orderPercent=size, maxPositionPercent="50",
            executionMode="1회만", waitMode="N봉 이후", waitInterval=F.when(number % 3 == 0, "0").otherwise("2"), maxExecutions="1.5",
        ),
    )
    flow = F.struct(F.concat(F.lit("flow-"), key).alias("key"), F.array(F.concat(F.lit("S"), (number % 100).cast("string"))).alias("officialInstrumentIds"), F.when(~first, per_flow).alias("steps"))
    partition = F.struct(F.lit("core").alias("key"), F.lit(10_000).alias("budgetCapBps"), F.array(flow).alias("flows"))
    strategy = F.struct(F.lit("snapshot.v1").alias("snapshotSchemaVersion"), F.concat(F.lit("m"), key).alias("semanticHash"), F.lit("s").alias("snapshotHash"))
    snapshot = F.struct(strategy.alias("immutableStrategyVersion"), F.lit("BASIC").alias("mode"), F.lit("10000.00000000").alias("initialCashAmount"), F.lit("USD").alias("currency"), F.array(partition).alias("partitions"))
    feature = F.struct(
        F.lit("rsi").alias("requirementId"), F.lit("f1").alias("featureId"), F.lit("1.0.0").alias("featureVersion"), F.array(F.lit("S9"), F.lit("S10")).alias("instruments"), F.lit("PT1M").alias("resolution"),
        F.col("p_size").alias("requiredObservations"),
    )
    catalogue = F.when(number % 13 == 0, "basic-elements:unknown").when(first, "basic-elements:2026-07-31").otherwise("basic-elements:2026-08-25")
    plan = F.struct(
        F.lit("strategy-bot.v1").alias("contractVersion"), F.when(first, "basic-compiled-plan.v1").otherwise("basic-compiled-plan.v2").alias("schemaVersion"), catalogue.alias("elementCatalogVersion"),
        F.lit("universe:1").alias("instrumentCatalogVersion"), F.lit("compiler:1").alias("compilerVersion"), F.lit("h").alias("requiredFeatureSetHash"), F.array(feature).alias("requiredFeatures"),
        snapshot.alias("executionSnapshot"), F.when(first, shared).alias("steps"),
    )
    return table(spark, folder, "part").select(number.alias("plan_id"), F.to_json(plan).alias("plan_json"))


@query(
    "plan_steps",
    """SELECT p_partkey AS plan_id, 'flow-' || p_partkey AS flow_id, s.seq AS step_no, CASE WHEN s.seq = 2 AND p_partkey % 4 <> 0 AND p_partkey % 11 = 0 THEN 4 ELSE s.seq + 1 END AS sequence,
      CASE WHEN p_partkey % 4 = 0 THEN s.old ELSE s.new END AS operation
    FROM part, (VALUES (0, 'LOAD_FEATURE', 'SMA_CROSS'), (1, 'COMPARE', 'RSI_CROSS'), (2, 'EMIT_ORDER_CANDIDATE', 'EMIT_ORDER_CANDIDATE')) s(seq, old, new)""",
)
def plan_steps(spark, folder):
    """Plan documents of both versions flattened to one row per step."""
    return P.flatten(_plans(spark, folder)).select("plan_id", "flow_id", "step_no", "sequence", "operation")


@query(
    "plan_lint",
    """WITH p AS (SELECT *, p_partkey % 4 = 0 AS first, p_partkey % 13 = 0 AS unsupported FROM part), o AS (SELECT * FROM p WHERE first AND NOT unsupported), n AS (SELECT * FROM p WHERE NOT first AND NOT unsupported)
    SELECT p_partkey AS plan_id, 2 AS sequence, 'operator' AS argument, 'NOT_ALLOWED' AS finding FROM o WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 1, 'longPeriod', 'NOT_ALLOWED' FROM n WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 2, 'direction', 'NOT_ALLOWED' FROM n WHERE p_partkey % 7 = 0
    UNION ALL SELECT p_partkey, 2, 'threshold', 'OUT_OF_BOUNDS' FROM n WHERE p_size * 3 > 100
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 3 END, 'orderPercent', 'OUT_OF_BOUNDS' FROM n WHERE p_size <= 0 OR p_size > 100
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 3 END, 'waitInterval', 'OUT_OF_BOUNDS' FROM n WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 3 END, 'maxExecutions', 'NOT_A_NUMBER' FROM n
    UNION ALL SELECT p_partkey, NULL, NULL, 'NON_CONTIGUOUS' FROM p WHERE NOT first AND p_partkey % 11 = 0
    UNION ALL SELECT p_partkey, NULL, NULL, 'UNSUPPORTED_CATALOGUE' FROM p WHERE unsupported""",
)
def plan_lint(spark, folder):
    steps = P.flatten(_plans(spark, folder))
    return P.lint(steps, P.specs(spark)).select("plan_id", "sequence", "argument", "finding")


@query(
    "plan_checksums",
    """SELECT p_partkey AS plan_id, 'sha256:' || sha256(array_to_string(['contractVersion=strategy-bot.v1', 'schemaVersion=basic-compiled-plan.v' || CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END, 'snapshotSchemaVersion=snapshot.v1',
      'semanticHash=m' || p_partkey, 'snapshotHash=s', 'elementCatalogVersion=basic-elements:' || CASE WHEN p_partkey % 13 = 0 THEN 'unknown' WHEN p_partkey % 4 = 0 THEN '2026-07-31' ELSE '2026-08-25' END,
      'instrumentCatalogVersion=universe:1', 'compilerVersion=compiler:1', 'requiredFeatureSetHash=h', 'mode=BASIC', 'initialCashAmount=10000.00000000', 'currency=USD',
      'requiredFeature=requirementId=rsi|featureId=f1|featureVersion=1.0.0|instruments=S10,S9|resolution=PT1M|requiredObservations=' || p_size,
      'partition=core|budgetCapBps=10000', 'flow=flow-' || p_partkey || '|officialInstrumentIds=S' || (p_partkey % 100),
      CASE WHEN p_partkey % 4 = 0 THEN 'step=1|LOAD_FEATURE|feature=RSI_14|resolution=1m' || chr(10) || 'step=2|COMPARE|operator=' || CASE WHEN p_partkey % 5 = 0 THEN 'BELOW' ELSE 'LT' END || '|threshold=' || p_size || chr(10)
        || 'step=3|EMIT_ORDER_CANDIDATE|allocation=EQUAL|orderType=MARKET|side=BUY'
      ELSE 'step=1|SMA_CROSS|direction=UP|longPeriod=' || CASE WHEN p_partkey % 9 = 0 THEN '45' ELSE '60' END || '|resolution=1d|shortPeriod=5' || chr(10)
        || 'step=2|RSI_CROSS|direction=' || CASE WHEN p_partkey % 7 = 0 THEN 'SIDEWAYS' ELSE 'UP' END || '|period=14|resolution=1d|threshold=' || (p_size * 3) || chr(10)
        || 'step=' || CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 3 END || '|EMIT_ORDER_CANDIDATE|allocation=EQUAL|executionMode=1회만|maxExecutions=1.5|maxPositionPercent=50|orderPercent=' || p_size
        || '|orderType=MARKET|side=BUY|timeInForce=DAY|waitInterval=' || CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END || '|waitMode=N봉 이후' END], chr(10))) AS checksum FROM part""",
)
def plan_checksums(spark, folder):
    return P.plan_checksum(_plans(spark, folder)).select("plan_id", "checksum")
