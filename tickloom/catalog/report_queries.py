"""Monthly judgment, detail parts, digests, run registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import sql as Q
from tickloom.catalog.base import money, query
from tickloom.catalog.fill_queries import BOOK, CURVE, FIFO, _book, _cost_curve, _per_run
from tickloom.functions import scalars as S
from tickloom.operators import calendar as cal
from tickloom.operators import detail as D
from tickloom.operators import digests as H
from tickloom.operators import joins as J
from tickloom.operators import monthly as M
from tickloom.operators import runs as N
from tickloom.operators.ledger import by_size
from tickloom.session import cut_lineage
from tickloom.sources.tables import table

# ---------------------------------------------------------------- monthly judgment
# evaluations: one per event; a purchase is a trade, an error a data gap; even users run BASIC, odd users PRO strategies.

_ET_MONTH = f"strftime({Q.et('{ts}')}, '%Y-%m')"
_EVAL = """
evl AS (SELECT event_id AS evaluation_id, user_id % 20 AS run_id, ts AS evaluated_at, CASE WHEN user_id % 2 = 0 THEN 'BASIC' ELSE 'PRO' END AS mode,
  event_type = 'purchase' AS trade_occurred, event_type = 'error' AS data_gap, CASE WHEN user_id % 2 = 0 THEN 0 WHEN event_type = 'signup' THEN 1 ELSE 2 END AS active_branches, value,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events),
rec AS (SELECT event_id AS record_id, user_id % 20 AS run_id, ts AS occurred_at, CASE WHEN value < 5 THEN 'REJECTION' ELSE 'FILL' END AS kind FROM events),
oc AS (SELECT *, 'BASIC' AS scope_id, TRUE AS active FROM evl WHERE mode = 'BASIC' UNION ALL SELECT *, 'A', TRUE FROM evl WHERE mode = 'PRO' UNION ALL SELECT *, 'B', event_type <> 'signup' FROM evl WHERE mode = 'PRO'),
ff AS (SELECT run_id, evaluation_id, evaluated_at, mode, scope_id, CASE WHEN scope_id = 'B' THEN CASE WHEN NOT k % 2 = 0 THEN 'EVEN' WHEN NOT value > 10 THEN 'OVER_10' END
  ELSE CASE WHEN NOT value > 10 THEN 'OVER_10' WHEN NOT value > 20 THEN 'OVER_20' WHEN NOT k % 2 = 0 THEN 'EVEN' END END AS condition_id FROM oc WHERE NOT trade_occurred AND active)
"""


def _evaluations(spark, folder):
    even = F.col("user_id") % 2 == 0
    return table(spark, folder, "events").select(
        F.col("event_id").alias("evaluation_id"),
        (F.col("user_id") % 20).alias("run_id"),
        F.col("ts").alias("evaluated_at"),
        F.when(even, "BASIC").otherwise("PRO").alias("mode"),
        (F.col("event_type") == "purchase").alias("trade_occurred"),
        (F.col("event_type") == "error").alias("data_gap"),
        F.when(even, 0).when(F.col("event_type") == "signup", 1).otherwise(2).alias("active_branches"),
        "value",
        F.from_json("props", "k int")["k"].alias("k"),
        "event_type",
    )


def _trade_records(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").alias("record_id"), (F.col("user_id") % 20).alias("run_id"), F.col("ts").alias("occurred_at"), F.when(F.col("value") < 5, "REJECTION").otherwise("FILL").alias("kind")
    )


def _outcomes(spark, folder):
    over10 = F.struct(F.lit("OVER_10").alias("condition_id"), (F.col("value") > 10).alias("passed"))
    over20 = F.struct(F.lit("OVER_20").alias("condition_id"), (F.col("value") > 20).alias("passed"))
    even = F.struct(F.lit("EVEN").alias("condition_id"), (F.col("k") % 2 == 0).alias("passed"))

    def scope(name, active, *steps):
        return F.struct(F.lit(name).alias("scope_id"), active.alias("active"), F.array(*steps).alias("steps"))

    scopes = F.when(F.col("mode") == "BASIC", F.array(scope("BASIC", F.lit(True), over10, over20, even))).otherwise(
        F.array(scope("A", F.lit(True), over10, over20, even), scope("B", F.col("event_type") != "signup", even, over10))
    )
    base = _evaluations(spark, folder).select("run_id", "evaluation_id", "evaluated_at", "mode", "trade_occurred", F.explode(scopes).alias("s"))
    return base.select("run_id", "evaluation_id", "evaluated_at", "mode", "trade_occurred", "s.scope_id", "s.active", F.posexplode("s.steps").alias("ordinal", "c")).select(
        "*", "c.condition_id", "c.passed"
    ).drop("c")


_COUNTERS = f"""
mc AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.m, b.m) AS et_month, coalesce(ev, 0) AS evaluation_count, coalesce(ab, 0) AS active_branch_count, coalesce(te, 0) AS trade_event_count,
  coalesce(dg, 0) AS data_gap_count, coalesce(tr, 0) AS triggered_count, coalesce(rj, 0) AS rejected_count
  FROM (SELECT run_id, {_ET_MONTH.format(ts="evaluated_at")} AS m, count(*) AS ev, CAST(sum(active_branches) AS BIGINT) AS ab, count(*) FILTER (data_gap) AS dg, count(*) FILTER (trade_occurred) AS tr FROM evl GROUP BY 1, 2) a
  FULL JOIN (SELECT run_id, {_ET_MONTH.format(ts="occurred_at")} AS m, count(*) AS te, count(*) FILTER (kind = 'REJECTION') AS rj FROM rec GROUP BY 1, 2) b ON a.run_id = b.run_id AND a.m = b.m)
"""


@query("monthly_counters", f"WITH {_EVAL}, {_COUNTERS} SELECT * FROM mc")
def monthly_counters(spark, folder):
    return M.monthly_counters(_evaluations(spark, folder), _trade_records(spark, folder))


@query("first_failures", f"WITH {_EVAL} SELECT run_id, evaluation_id, mode, scope_id, condition_id FROM ff WHERE condition_id IS NOT NULL")
def first_failures(spark, folder):
    return M.first_failures(_outcomes(spark, folder)).drop("evaluated_at")


@query(
    "failure_histogram",
    f"WITH {_EVAL} SELECT run_id, {_ET_MONTH.format(ts='evaluated_at')} AS et_month, mode, scope_id, condition_id, count(*) AS occurrence_count FROM ff WHERE condition_id IS NOT NULL GROUP BY ALL",
)
def failure_histogram(spark, folder):
    return M.failure_histogram(M.first_failures(_outcomes(spark, folder)))


@query(
    "monthly_trade_ids",
    f"WITH {_EVAL}, m AS (SELECT *, {_ET_MONTH.format(ts='occurred_at')} AS et_month FROM rec) SELECT run_id, et_month, row_number() OVER (PARTITION BY run_id, et_month ORDER BY occurred_at, record_id) AS ordinal, record_id FROM m",
)
def monthly_trade_ids(spark, folder):
    return M.monthly_trade_ids(_trade_records(spark, folder))


@query("monthly_totals", f"WITH {_EVAL}, {_COUNTERS} SELECT run_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in M.COUNTERS)} FROM mc GROUP BY 1")
def monthly_totals(spark, folder):
    return M.total_counters(monthly_counters(spark, folder))


def _documents(spark, folder):
    histogram = M.failure_histogram(M.first_failures(_outcomes(spark, folder)))
    return M.summary_documents(monthly_counters(spark, folder), histogram, cut_lineage(M.monthly_trade_ids(_trade_records(spark, folder))))


@query("monthly_documents")
def monthly_documents(spark, folder):
    return _documents(spark, folder)


@query("monthly_documents_verified", "SELECT DISTINCT user_id % 20 AS run_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m') AS et_month FROM events WHERE user_id % 20 % 5 = 0")
def monthly_documents_verified(spark, folder):
    """Stored documents re-hashed; those of every fifth run were altered by a space."""
    altered = _documents(spark, folder).withColumn("document", F.when(F.col("run_id") % 5 == 0, F.concat("document", F.lit(" "))).otherwise(F.col("document")))
    return M.verify_documents(altered).select("run_id", "et_month")


# ---------------------------------------------------------------- detail parts

_WEEK = f"CAST(date_trunc('week', {Q.et('{ts}')}) AS DATE)"
_PART_ROWS = D.ROWS_PER_PART


def _fields(*names: str) -> str:
    """Fields as length:text, a missing one as a minus sign."""
    return " || ".join(f"coalesce(strlen({n}::VARCHAR) || ':' || {n}::VARCHAR, '-')" for n in names)


_DETAIL = f"""
dr AS (SELECT run_id, 'TRADE' AS record_type, occurred_at, {_WEEK.format(ts="occurred_at")} AS week_start, {_fields('order_id', 'line_no', 'part_id', 'instrument_id')} AS record_id,
  order_id, line_no, part_id, gross_amount FROM bk),
dp AS (SELECT *, CAST((row_number() OVER (PARTITION BY run_id, record_type, week_start ORDER BY occurred_at, record_id) - 1) // {_PART_ROWS} + 1 AS INTEGER) AS part FROM dr),
pm AS (SELECT run_id, record_type, week_start, part, min(occurred_at) AS period_start, max(occurred_at) AS period_end, count(*) AS row_count,
  sha256(string_agg(record_id, chr(10) ORDER BY occurred_at, record_id)) AS identities_hash FROM dp GROUP BY ALL)
"""


def _detail(log, whole):
    trades = D.detail_rows(_book(log, whole), "TRADE", "occurred_at", ["order_id", "line_no", "part_id", "instrument_id"], ["side", "executed", "gross_amount", "fee"])
    weeks = D.assign_week(trades.drop("payload"), "occurred_at")
    return D.number_parts(weeks if whole else cut_lineage(weeks), "occurred_at", ["record_id"], _PART_ROWS, whole)


@query("detail_weeks", f"WITH {BOOK}, {_DETAIL} SELECT run_id, record_type, week_start, part, record_id, occurred_at FROM dp")
def detail_weeks(spark, folder):
    """Trade detail rows with local week and part number."""
    return _per_run(spark, folder, _detail).select("run_id", "record_type", "week_start", "part", "record_id", "occurred_at")


@query("part_manifest", f"WITH {BOOK}, {_DETAIL} SELECT * FROM pm")
def part_manifest(spark, folder):
    return _per_run(spark, folder, lambda log, whole: D.part_manifest(_detail(log, whole), "occurred_at", "record_id"))


@query(
    "detail_keys",
    f"""WITH {BOOK}, {_DETAIL}, k AS (SELECT *, 'results/' || run_id || '/' || record_type || '/week_start=' || strftime(week_start, '%Y-%m-%d') || '/part=' || lpad(CAST(part AS VARCHAR), 4, '0') || '/' || identities_hash || '.parquet' AS object_key FROM pm)
    SELECT object_key, CAST(run_id AS VARCHAR) AS run_id, record_type, week_start, part, identities_hash AS content_hash, length(identities_hash) = 64 AS hash_ok FROM k""",
)
def detail_keys(spark, folder):
    """Object keys built from manifests and parsed back."""
    keys = part_manifest(spark, folder).select(D.detail_key("results", F.col("identities_hash")).alias("object_key"))
    parsed = keys.select("object_key", *[c.alias(n) for n, c in D.parse_detail_key("object_key").items()])
    return parsed.withColumn("hash_ok", S.is_sha256("content_hash"))


@query("monthly_trades", f"WITH {BOOK}, {_DETAIL} SELECT run_id, week_start, part, record_id FROM dp WHERE {_ET_MONTH.format(ts='occurred_at')} = '1998-03'")
def monthly_trades(spark, folder):
    return N.monthly_trades(_per_run(spark, folder, _detail), "1998-03").select("run_id", "week_start", "part", "record_id")


@query("equity_points", f"WITH {FIFO}, {CURVE} SELECT run_id, 'equity' AS metric, as_of, {Q.money('equity')} AS value, 36 AS id_length FROM cv")
def equity_points(spark, folder):
    curve = _cost_curve(spark, folder)
    return D.equity_points(curve).select("run_id", "metric", "as_of", money("value").alias("value"), F.length("point_id").alias("id_length"))


@query(
    "equity_series",
    f"WITH {FIFO}, {CURVE} SELECT run_id, as_of, {Q.money('equity')} AS equity FROM cv WHERE as_of >= TIMESTAMP '1998-01-01' AND as_of < TIMESTAMP '1999-01-01'",
)
def equity_series(spark, folder):
    curve = _cost_curve(spark, folder)
    picked = curve.filter("as_of >= TIMESTAMP '1998-01-01' AND as_of < TIMESTAMP '1999-01-01'")
    return picked.select("run_id", "as_of", money("equity").alias("equity"))


# ---------------------------------------------------------------- digests


def _tree_sql(source: str, key: str) -> str:
    return f"""
h0 AS (SELECT {key}, h, count(*) AS n FROM {source} GROUP BY ALL),
h1 AS (SELECT {key}, substr(h, 1, 6) AS p, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS t FROM h0 GROUP BY ALL),
h2 AS (SELECT {key}, substr(p, 1, 3) AS p2, sha256(string_agg(p || '=' || t, ',' ORDER BY p || '=' || t)) AS t FROM h1 GROUP BY ALL),
h3 AS (SELECT {key}, sha256(string_agg(p2 || '=' || t, ',' ORDER BY p2 || '=' || t)) AS digest FROM h2 GROUP BY ALL)
"""


_ROW = "SELECT l_suppkey AS run_id, sha256(" + _fields("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag") + ") AS h FROM lineitem"


@query("run_digests", f"WITH src AS ({_ROW}), {_tree_sql('src', 'run_id')} SELECT * FROM h3")
def run_digests(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("run_id", F.col("l_suppkey"))
    return by_size(lines, lambda rows, whole: H.run_digest(rows, ["run_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]))


@query(
    "run_digest_diff",
    "SELECT DISTINCT l_suppkey AS run_id FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'A'",
)
def run_digest_diff(spark, folder):
    """Runs whose digest changes when their largest accepted lines are altered: exactly the runs that have such lines."""
    lines = table(spark, folder, "lineitem").withColumn("run_id", F.col("l_suppkey"))
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"]
    quantity = F.when((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "A"), 51.0).otherwise(F.col("l_quantity"))

    def differing(rows, whole):
        return H.diff_runs(H.run_digest(rows, ["run_id"], columns), H.run_digest(rows.withColumn("l_quantity", quantity), ["run_id"], columns), ["run_id"])

    return by_size(lines.select("run_id", *columns), differing).select("run_id")


_OBJ = f"""
ob AS (SELECT {_WEEK.format(ts="ts")} AS week, date_trunc('day', ts) AS d, user_id % 16 AS shard, count(*) AS row_count, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL)
"""


def _objects(spark, folder):
    day = F.date_trunc("day", "ts")
    return (
        table(spark, folder, "events")
        .groupBy(cal.et_week("ts").alias("dataset_id"), day.alias("d"), (F.col("user_id") % 16).alias("shard"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.date_trunc("second", F.min("ts")).alias("lo"), F.date_trunc("second", F.max("ts")).alias("hi"))
        .select(
            "dataset_id",
            "shard",
            S.sha256(F.concat_ws("/", F.date_format("d", "yyyy-MM-dd"), F.col("shard").cast("string"))).alias("content_hash"),
            F.lit("BARS").alias("object_kind"),
            F.lit("DAY").alias("partition_granularity"),
            S.utc_text("d").alias("partition_start"),
            S.utc_text(F.col("d") + F.expr("INTERVAL 1 DAY")).alias("partition_end"),
            S.utc_text("lo").alias("period_start"),
            S.utc_text("hi").alias("period_end"),
            F.concat(F.lit("s"), F.lpad(F.col("shard").cast("string"), 2, "0"), F.lit("-of-16")).alias("shard_key"),
            F.lit(1).alias("part_number"),
            "row_count",
            F.lit("market-bars-v2").alias("schema_version"),
        )
    )


_ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "dataset_hashes",
    f"""WITH {_OBJ}, j AS (SELECT week AS dataset_id, CAST(json_object('content_hash', sha256(strftime(d, '%Y-%m-%d') || '/' || shard), 'object_kind', 'BARS', 'part_number', 1, 'partition_end', {_ISO.format(t="d + INTERVAL 1 DAY")},
      'partition_granularity', 'DAY', 'partition_start', {_ISO.format(t="d")}, 'period_end', {_ISO.format(t="hi")}, 'period_start', {_ISO.format(t="lo")}, 'row_count', row_count, 'schema_version', 'market-bars-v2',
      'shard_key', 's' || lpad(CAST(shard AS VARCHAR), 2, '0') || '-of-16') AS VARCHAR) AS t FROM ob)
    SELECT dataset_id, sha256('[' || string_agg(t, ',' ORDER BY t) || ']') AS dataset_hash FROM j GROUP BY 1""",
)
def dataset_hashes(spark, folder):
    """Manifest digests; a dataset is one week of sixteen shards."""
    return H.dataset_hash(_objects(spark, folder), ["dataset_id"])


@query(
    "loader_dataset_hashes",
    f"""WITH {_OBJ}, e AS (SELECT week AS dataset_id, 's' || lpad(shard::VARCHAR, 2, '0') || '-of-16' AS shard_key,
      '{{"content_hash":"' || sha256(strftime(d, '%Y-%m-%d') || '/' || shard) || '","part_number":1,"shard_key":"s' || lpad(shard::VARCHAR, 2, '0') || '-of-16"}}' AS entry FROM ob)
    SELECT dataset_id, sha256('resolution={{"v":"30m"}}' || chr(10) || 'week={{"v":"' || dataset_id || '"}}' || chr(10) || string_agg(entry, ',' ORDER BY shard_key, entry)) AS dataset_hash FROM e GROUP BY 1""",
)
def loader_dataset_hashes(spark, folder):
    return H.loader_dataset_hash(_objects(spark, folder), ["dataset_id"], {"resolution": F.lit("30m"), "week": F.col("dataset_id").cast("string")})


# ---------------------------------------------------------------- run registry


def _runs(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("UNAVAILABLE").alias("status"),
        F.col("o_orderdate").alias("queued_at"),
        (F.col("o_orderpriority") == "5-LOW").alias("deleted"),
        (F.col("o_orderpriority") == "1-URGENT").alias("cancel_requested"),
        F.lit("REQUIRED_DATA_UNAVAILABLE").alias("unavailable_reason"),
        F.concat(F.lit("FAILURE_"), F.substring("o_orderpriority", 1, 1)).alias("failure_code"),
    )


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'UNAVAILABLE' END"


@query("list_runs", f"SELECT o_orderkey AS run_id, {_STATUS} AS status, o_orderdate AS queued_at FROM orders WHERE o_custkey = 7 AND o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 1")
def list_runs(spark, folder):
    return N.list_runs(_runs(spark, folder), 7, 1, 5).select("run_id", "status", "queued_at")


@query("run_overview", f"SELECT o_orderkey AS run_id, {_STATUS} AS status, CASE o_orderstatus WHEN 'P' THEN 'REQUIRED_DATA_UNAVAILABLE' WHEN 'F' THEN 'FAILURE_' || substr(o_orderpriority, 1, 1) END AS reason_code FROM orders")
def run_overview(spark, folder):
    return N.overview(_runs(spark, folder)).select("run_id", "status", "reason_code")


@query("attempt_counts", "SELECT o_orderkey AS run_id, count(l_orderkey) AS attempts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def attempt_counts(spark, folder):
    attempts = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return N.attempt_counts(_runs(spark, folder), attempts).select("run_id", "attempts")


@query(
    "run_inputs",
    """WITH p AS (SELECT l_orderkey AS run_id, count(*) AS pins, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS dataset_names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT o_orderkey AS run_id, pins, dataset_names FROM orders LEFT JOIN p ON p.run_id = o_orderkey""",
)
def run_inputs(spark, folder):
    pins = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("dataset_id"))
    datasets = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("dataset_id"), F.col("s_name").alias("dataset_name"))
    return N.inputs_and_models(_runs(spark, folder), pins, datasets).select("run_id", "pins", "dataset_names")


@query(
    "stale_runs",
    f"""WITH a AS (SELECT l_orderkey AS run_id, max(l_linenumber) AS n, arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey)) AS s, arg_max(l_shipdate, (l_linenumber, l_partkey, l_suppkey)) AS e FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS run_id, CASE WHEN s = 'O' AND e > TIMESTAMP '2000-01-01' THEN 'LIVE' WHEN o_orderpriority = '1-URGENT' THEN 'CANCELLED' WHEN coalesce(n, 0) >= 7 THEN 'EXHAUSTED'
      WHEN n IS NULL THEN 'INCONSISTENT' ELSE 'LEASE_EXPIRED' END AS finding FROM orders LEFT JOIN a ON a.run_id = o_orderkey WHERE o_orderstatus = 'O'""",
)
def stale_runs(spark, folder):
    attempts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("attempt_number"), "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "O", "RUNNING").otherwise("FAILED").alias("attempt_status"), F.col("l_shipdate").alias("lease_expires_at"),
    )
    latest = J.latest_per_key(attempts, ["run_id"], ["attempt_number", "l_partkey", "l_suppkey"], ["attempt_status", "lease_expires_at"])
    return N.stale_runs(_runs(spark, folder), latest, "2000-01-01", 7).select("run_id", "finding")


@query(
    "object_availability",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN 'MISSING' WHEN p_size < 25 THEN 'NOT_AVAILABLE' ELSE 'AVAILABLE' END AS availability FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 10",
)
def object_availability(spark, folder):
    ids = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") + 10).alias("object_id"))
    objects = table(spark, folder, "part").select(F.col("p_partkey").alias("object_id"), F.when(F.col("p_size") < 25, "DELETED").otherwise("AVAILABLE").alias("status"))
    return N.object_availability(ids, objects).select("l_orderkey", "l_linenumber", "l_partkey", "availability")


@query("result_conflicts", "SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def result_conflicts(spark, folder):
    objects = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.when(F.col("l_returnflag") == "A", "AVAILABLE").otherwise("STAGED").alias("status"),
        F.concat(F.lit("runs/"), F.when(F.col("l_linestatus") == "F", "result/").otherwise("detail/"), F.col("l_linenumber").cast("string")).alias("object_key"),
    )
    return N.result_conflicts(objects)


_REQ = """
rq AS (SELECT event_id AS arrival, ts AS arrived_at, user_id % 50 AS aggregate_id, CAST(floor(event_id / 3) AS BIGINT) AS message_id, CAST(value * 100 AS BIGINT) % 2 AS payload_hash, date_diff('second', TIMESTAMP '2024-01-01', ts) - CAST(value * 60 AS BIGINT) AS sequence FROM events)
"""


@query(
    "request_intake",
    f"""WITH {_REQ}, f AS (SELECT message_id, arg_min(arrival, (arrived_at, arrival)) AS fa, arg_min(payload_hash, (arrived_at, arrival)) AS fh FROM rq GROUP BY 1),
    m AS (SELECT rq.*, arrival = fa AS is_first, fh FROM rq JOIN f USING (message_id)),
    w AS (SELECT *, max(CASE WHEN is_first THEN sequence END) OVER (PARTITION BY aggregate_id ORDER BY arrived_at, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM m)
    SELECT arrival, message_id, CASE WHEN NOT is_first AND payload_hash <> fh THEN 'CONFLICT' WHEN NOT is_first THEN 'DUPLICATE' WHEN sequence <= latest THEN 'STALE' ELSE 'CLAIMED' END AS outcome FROM w""",
)
def request_intake(spark, folder):
    return N.dedupe_requests(_requests(table(spark, folder, "events"))).select("arrival", "message_id", "outcome")


def _requests(events):
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    second = F.floor((F.unix_micros(F.date_trunc("second", "ts")) - start) / 1_000_000)
    return events.select(
        F.col("event_id").alias("arrival"),
        F.col("ts").alias("arrived_at"),
        (F.col("user_id") % 50).alias("aggregate_id"),
        F.floor(F.col("event_id") / 3).cast("long").alias("message_id"),
        (F.round(F.col("value") * 100).cast("long") % 2).alias("payload_hash"),
        (second - F.round(F.col("value") * 60).cast("long")).alias("sequence"),
    )


@query(
    "positions_attached",
    f"""WITH c AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || CAST(l_quantity AS INTEGER), ',' ORDER BY l_linenumber, CAST(l_quantity AS INTEGER)) AS positions FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS record_id, positions FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def positions_attached(spark, folder):
    """Child rows nested into their parent record."""
    children = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("int").alias("q"))
    parents = table(spark, folder, "orders").select(F.col("o_orderkey").alias("record_id"))
    nested = J.nest_children(parents, children, ["record_id"], ["i", "q"], "positions_after")
    text = F.array_join(F.transform("positions_after", lambda p: F.concat_ws(":", p["i"].cast("string"), p["q"].cast("string"))), ",")
    return nested.select("record_id", text.alias("positions"))


