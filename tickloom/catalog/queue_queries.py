"""Orders that share capacity, causal chains, gates of position cycles, late bars, refused sells, daily metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import sql as Q
from tickloom.catalog.base import money, num, query
from tickloom.catalog.check_queries import _MARKET_SQL, _bar_dataset, _store
from tickloom.catalog.fill_queries import _EVENT_FL, _K, _ORD, BOOK, CURVE, FIFO, ID, INITIAL_CASH, _basis, _book, _booked, _per_run
from tickloom.catalog.inputs import FILL_KEYS, FILL_ORDER, calendar, event_bar_events, fill_log, supplier_days
from tickloom.functions.scalars import price
from tickloom.operators import bars as B
from tickloom.operators import calendar as cal
from tickloom.operators import detail as D
from tickloom.operators import fills as X
from tickloom.operators import gates as G
from tickloom.operators import ledger as L
from tickloom.operators import valuation as V
from tickloom.operators.capacity import share_capacity
from tickloom.operators.causal import causal_order as chain
from tickloom.operators.digests import joined_fields
from tickloom.operators.scan import Running, prefix_scan
from tickloom.catalog.report_queries import _WEEK, _fields
from tickloom.schemas import BARS
from tickloom.session import cut_lineage
from tickloom.sources import market, verified
from tickloom.sources.tables import table

_IDS = ", ".join(ID)

# ---------------------------------------------------------------- shared capacity

_SHARED = f"""{Q.SUPPLIER_DAYS},
cb AS (SELECT instrument_id, starts_at, CAST(volume * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(28,8)) AS cap FROM sbars),
cx AS (SELECT *, CAST(sum(cap) OVER (PARTITION BY instrument_id ORDER BY starts_at) AS DECIMAL(28,8)) AS hi FROM cb),
o0 AS (SELECT 'S' || l_suppkey AS instrument_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate AS eligible_at, CAST(2 * l_quantity AS DECIMAL(28,8)) AS q, CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem),
o1 AS (SELECT *, CASE t % 3 WHEN 0 THEN eligible_at + INTERVAL 1 DAY WHEN 1 THEN eligible_at + INTERVAL 90 DAY ELSE eligible_at + to_days(CAST(3 * t AS INTEGER)) END AS expires_at,
  row_number() OVER (PARTITION BY instrument_id ORDER BY eligible_at, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM o0),
oa AS (SELECT o1.*, coalesce(c.hi, 0) AS a FROM o1 ASOF LEFT JOIN cx c ON c.instrument_id = o1.instrument_id AND c.starts_at < o1.eligible_at),
od AS (SELECT oa.*, coalesce(c.hi, 0) AS d FROM oa ASOF LEFT JOIN cx c ON c.instrument_id = oa.instrument_id AND c.starts_at < oa.expires_at),
sv AS (SELECT instrument_id, pos, CAST(greatest(0, least(a + q, d)) AS DECIMAL(28,8)) AS f, CAST(0 AS DECIMAL(28,8)) AS g FROM od WHERE pos = 1
  UNION ALL SELECT od.instrument_id, od.pos, CAST(greatest(sv.f, least(greatest(sv.f, a) + q, d)) AS DECIMAL(28,8)), sv.f FROM sv JOIN od ON od.instrument_id = sv.instrument_id AND od.pos = sv.pos + 1),
st AS (SELECT od.*, sv.f AS e, greatest(sv.g, od.a) AS b FROM od JOIN sv USING (instrument_id, pos) WHERE sv.f > greatest(sv.g, od.a))
"""


@query(
    "shared_capacity",
    f"""WITH RECURSIVE {_SHARED} SELECT st.instrument_id, l_orderkey, l_linenumber, l_partkey, {Q.money("l_extendedprice")} AS extended_price, cx.starts_at, {Q.money("least(e, hi) - greatest(b, hi - cap)")} AS filled_quantity,
      {Q.money("q - (least(e, hi) - b)")} AS remaining, CASE WHEN q = least(e, hi) - b THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END AS fill_status
    FROM st JOIN cx ON cx.instrument_id = st.instrument_id AND cx.hi > b AND cx.hi - cap < e""",
)
def shared_capacity(spark, folder):
    """Every line an order for twice its quantity: day orders, orders of 90 days and of given days share half of each day's volume."""
    t = F.round(F.col("l_tax") * 100).cast("int")
    days = F.when(t % 3 == 0, 1).when(t % 3 == 1, 90).otherwise(3 * t)
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    extended = money(price("l_extendedprice"))
    orders = table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("instrument_id"), F.concat_ws(":", *ids, extended).alias("order_id"), *ids, "l_extendedprice",
        (price("l_quantity") * 2).cast("decimal(18,8)").alias("quantity"), F.col("l_shipdate").alias("eligible_at"), F.timestamp_micros(F.unix_micros("l_shipdate") + days.cast("long") * F.lit(86_400_000_000)).alias("expires_at"),
    )
    bars = supplier_days(spark, folder).select("instrument_id", "starts_at", "volume")
    capacity = X.bar_capacity(X.Policy(participation="0.5"))
    shared = share_capacity(orders, bars, capacity, ["eligible_at", *ids, "l_extendedprice"], F.date_trunc("month", "eligible_at"), 10_000.0)
    parts = F.split("order_id", ":")
    kinds = ["long", "int", "long"]
    return shared.select(
        "instrument_id", *[parts[i].cast(kind).alias(c) for i, (c, kind) in enumerate(zip(ids, kinds, strict=True))], parts[3].alias("extended_price"), "starts_at",
        money("filled_quantity").alias("filled_quantity"), money("remaining").alias("remaining"), "fill_status",
    )


# ---------------------------------------------------------------- causal order

_CASH = f"sum(CASE WHEN side = 'BUY' THEN -(gross_amount + fee) ELSE gross_amount - fee END) OVER (PARTITION BY run_id ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING)"


@query(
    "causal_order",
    f"""WITH {BOOK}, c AS (SELECT *, {_CASH} AS after FROM bk), d AS (SELECT *, after - CASE WHEN side = 'BUY' THEN -(gross_amount + fee) ELSE gross_amount - fee END AS before,
      row_number() OVER (PARTITION BY run_id ORDER BY {_ORD}) AS n FROM c),
    t AS (SELECT d.*, count(*) OVER (PARTITION BY run_id, before) > 1 AS shared FROM d), b AS (SELECT *, min(CASE WHEN shared THEN n END) OVER (PARTITION BY run_id) AS bad, min(CASE WHEN run_id % 10 = 3 AND n = 5 THEN n END) OVER (PARTITION BY run_id) AS gone FROM t)
    SELECT {_IDS}, CASE WHEN n < coalesce(least(bad, gone), n + 1) THEN n END AS ordinal, CASE WHEN n < coalesce(least(bad, gone), n + 1) THEN 'ORDERED' WHEN n > coalesce(gone, n) AND n < coalesce(bad, n + 1) THEN 'BROKEN' ELSE 'BRANCHED' END AS chain_status
    FROM b WHERE gone IS NULL OR n <> gone""",
)
def causal_order(spark, folder):
    """Booked fills in the order their cash balances imply; the fifth fill of every tenth run is missing."""
    delta = L.cash_delta()
    slim = _booked(spark, folder).select(*dict.fromkeys([*FILL_KEYS, *FILL_ORDER]), delta.alias("_d"))
    fills = prefix_scan(slim, ["run_id"], FILL_ORDER, F.date_trunc("month", "occurred_at"), {"_n": Running("count", F.lit(1)), "_c": Running("sum", F.col("_d"))})
    left = (F.lit(INITIAL_CASH).cast("decimal(24,8)") + F.col("_c")).cast("decimal(24,8)")
    kept = fills.filter((F.col("run_id") % 10 != 3) | (F.col("_n") != 5)).select(*ID, left.alias("_left"), (left - F.col("_d")).cast("decimal(24,8)").alias("_found"))
    done = chain(kept, ["run_id"], "order_id", [F.col("_found")], [F.col("_left")], [F.lit(INITIAL_CASH).cast("decimal(24,8)")])
    return done.select(*ID, "ordinal", "chain_status")


# ---------------------------------------------------------------- gates of a position cycle

_SCOPES = f"""{_EVENT_FL} {BOOK[BOOK.index("b1 AS"):]},
sc AS (SELECT *, sum(CASE WHEN side = 'BUY' AND held_before = 0 THEN 1 ELSE 0 END + CASE WHEN held_after = 0 THEN 1 ELSE 0 END) OVER {_K} AS scope FROM bk),
ev0 AS (SELECT event_id, user_id AS run_id, event_type AS instrument_id, ts AS decided_at, {Q.et_date("ts")} AS d FROM events WHERE value > 5),
gs AS (SELECT e.event_id, e.run_id, e.instrument_id, e.decided_at, coalesce(s.scope, 0) AS scope, x.session_index FROM ev0 e ASOF LEFT JOIN (SELECT run_id, instrument_id, occurred_at, max(scope) AS scope FROM sc GROUP BY ALL) s
  ON s.run_id = e.run_id AND s.instrument_id = e.instrument_id AND s.occurred_at <= e.decided_at JOIN ses x ON x.session_date = e.d)
"""


def _event_fills(spark, folder):
    k = F.from_json("props", "k int")["k"]
    quantity = (1 + k % 5).cast("decimal(18,8)")
    unit = (price("value") + F.lit(1).cast("decimal(1,0)")).cast("decimal(18,8)")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("instrument_id"), F.col("ts").alias("occurred_at"), F.col("event_id").alias("order_id"), F.lit(0).alias("line_no"), F.lit(0).alias("part_id"),
        F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"), quantity.alias("quantity"), (unit * quantity).cast("decimal(18,8)").alias("gross_amount"), *[F.lit(0).cast("decimal(18,8)").alias(c) for c in ("fee", "slippage", "fee_rate", "slippage_rate")],
    )


def _scoped_candidates(spark, folder):
    """Decisions over 5 inside a session, with the position scope they belong to and the number of their session."""
    booked = cut_lineage(L.book(_event_fills(spark, folder), FILL_KEYS, FILL_ORDER, F.date_trunc("day", "occurred_at")))
    changes = L.position_changes(booked)
    decided = table(spark, folder, "events").filter("value > 5").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("instrument_id"), F.col("ts").alias("decided_at"))
    scoped = G.position_scopes(decided, changes, FILL_KEYS, "decided_at", F.date_trunc("day", "at"))
    sessions = cal.session_index(calendar(spark)).select("session_date", "session_index")
    day = F.to_date(F.from_utc_timestamp("decided_at", "America/New_York"))
    return cut_lineage(scoped.withColumn("session_date", day).join(sessions, "session_date").drop("session_date"))


@query("gate_position_cycle", f"WITH {Q.CALENDAR}, {_SCOPES} SELECT event_id, run_id, instrument_id, scope, row_number() OVER w AS execution FROM gs WINDOW w AS (PARTITION BY run_id, instrument_id, scope ORDER BY decided_at, event_id) QUALIFY row_number() OVER w <= 2")
def gate_position_cycle(spark, folder):
    """The first two candidates of each position cycle; a new position, or none, opens the gate anew."""
    rows = _scoped_candidates(spark, folder)
    limited = G.first_n(rows, [*FILL_KEYS, "scope"], ["decided_at", "event_id"], F.date_trunc("day", "decided_at"), 2)
    return limited.select("event_id", "run_id", "instrument_id", "scope", "execution")


@query(
    "gate_trading_days",
    f"""WITH RECURSIVE {Q.CALENDAR}, {_SCOPES}, c AS (SELECT DISTINCT run_id, instrument_id, scope, session_index FROM gs),
    acc(run_id, instrument_id, scope, session_index) AS (SELECT run_id, instrument_id, scope, min(session_index) FROM c GROUP BY ALL UNION ALL
      SELECT acc.run_id, acc.instrument_id, acc.scope, min(c.session_index) FROM acc JOIN c ON c.run_id = acc.run_id AND c.instrument_id = acc.instrument_id AND c.scope = acc.scope AND c.session_index >= acc.session_index + 2
      GROUP BY acc.run_id, acc.instrument_id, acc.scope, acc.session_index)
    SELECT run_id, instrument_id, scope, session_index, arg_min(event_id, (decided_at, event_id)) AS event_id FROM gs JOIN acc USING (run_id, instrument_id, scope, session_index) GROUP BY ALL""",
)
def gate_trading_days(spark, folder):
    """Two trading days between executions of a position cycle."""
    rows = _scoped_candidates(spark, folder)
    first = rows.groupBy(*FILL_KEYS, "scope", "session_index").agg(F.min_by("event_id", F.struct("decided_at", "event_id")).alias("event_id"))
    return G.spaced(cut_lineage(first), [*FILL_KEYS, "scope"], "session_index", 2).select(*FILL_KEYS, "scope", "session_index", "event_id")


# ---------------------------------------------------------------- visibility of late bars

_LATE = """
lt AS (SELECT instrument_id, starts_at, ends_at, close, ends_at + to_microseconds((epoch_us(starts_at) // 60000000 * 7 % 11) * 600000000) AS available_at, 0 AS source_sequence FROM ev
  UNION ALL SELECT instrument_id, starts_at, ends_at, close + 1, ends_at + INTERVAL 3 HOUR, 1 FROM ev WHERE epoch_us(starts_at) // 60000000 % 4 = 0),
lr AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY available_at, source_sequence, starts_at) AS n FROM lt)
"""


def _late_events(spark, folder):
    events = event_bar_events(spark, folder).select("instrument_id", "starts_at", "ends_at", "close")
    minute = F.floor(F.unix_micros("starts_at") / 60_000_000)
    lag = F.timestamp_micros(F.unix_micros("ends_at") + (minute * 7 % 11) * F.lit(600_000_000))
    first = events.select("*", lag.alias("available_at"), F.lit(0).alias("source_sequence"))
    again = events.filter(minute % 4 == 0).select(
        "instrument_id", "starts_at", "ends_at", (F.col("close") + F.lit(1).cast("decimal(1,0)")).cast("decimal(18,8)").alias("close"), (F.col("ends_at") + F.expr("INTERVAL 3 HOURS")).alias("available_at"), F.lit(1).alias("source_sequence")
    )
    return first.unionByName(again)


@query(
    "visible_late_bars",
    f"""WITH {Q.CALENDAR}, {Q.TICKS}, {Q.bars(1800)}, {Q.bar_events("30m", 1800)}, {_LATE},
    dc AS (SELECT DISTINCT instrument_id, ends_at AS decided_at FROM ev), dn AS (SELECT dc.*, lr.n FROM dc ASOF JOIN (SELECT instrument_id, available_at, max(n) AS n FROM lr GROUP BY ALL) lr ON lr.instrument_id = dc.instrument_id AND lr.available_at <= dc.decided_at)
    SELECT dn.instrument_id, dn.decided_at, count(*) AS visible_bars, min(starts_at) AS oldest_start, max(starts_at) AS newest_start, {Q.num("sum(close)")} AS close_sum
    FROM dn JOIN lr ON lr.instrument_id = dn.instrument_id AND lr.n <= dn.n AND lr.n > dn.n - 180 GROUP BY ALL""",
)
def visible_late_bars(spark, folder):
    """What is visible at each bar's end when bars are published up to 100 minutes late, not in their order, and some are corrected."""
    events = cut_lineage(_late_events(spark, folder))
    decisions = event_bar_events(spark, folder).select("instrument_id", F.col("ends_at").alias("decided_at")).distinct()
    frames = {"visible_bars": F.count(F.lit(1)), "oldest_start": F.min("starts_at"), "newest_start": F.max("starts_at"), "close_sum": F.sum("close")}
    seen = B.visible_at(events, decisions, ["instrument_id"], "available_at", ["source_sequence", "starts_at"], "decided_at", frames, 180)
    return seen.filter("visible_bars IS NOT NULL").select("instrument_id", "decided_at", "visible_bars", "oldest_start", "newest_start", num("close_sum").alias("close_sum"))


# ---------------------------------------------------------------- refused sells

_ALL_SELLS = BOOK.replace(" FROM b4 WHERE executed > 0)", " FROM b4)")


@query(
    "sell_outcomes",
    f"""WITH {_ALL_SELLS} SELECT {_IDS}, {Q.money("quantity")} AS quantity, {Q.money("executed")} AS executed, {Q.money("quantity - executed")} AS refused,
      CASE WHEN executed = quantity THEN 'FILLED' WHEN executed > 0 THEN 'CUT' ELSE 'REJECTED' END AS outcome, CASE WHEN executed < quantity THEN 'POSITION_UNAVAILABLE' END AS reason_code FROM b5 WHERE side = 'SELL'""",
)
def sell_outcomes(spark, folder):
    """Every sell with what was executed and what was refused; none vanishes."""
    sells = L.book(fill_log(spark, folder), FILL_KEYS, FILL_ORDER, F.date_trunc("week", "occurred_at"), refused=True).filter("side = 'SELL'")
    return L.sell_outcomes(sells).select(*ID, *[money(c).alias(c) for c in ("quantity", "executed", "refused")], "outcome", "reason_code")


# ---------------------------------------------------------------- daily metrics

_DAILY = f"""
mk AS (SELECT instrument_id, CAST(occurred_at AS DATE) AS day, arg_max(CAST(round_even(CAST(CAST(gross0 AS DOUBLE) / CAST(quantity AS DOUBLE) AS DECIMAL(28,12)), 8) AS DECIMAL(18,8)), (occurred_at, order_id, line_no, part_id, gross0)) AS mark FROM fl GROUP BY 1, 2),
dd AS (SELECT DISTINCT day FROM mk), rr AS (SELECT run_id, min(CAST(occurred_at AS DATE)) AS d0 FROM bk GROUP BY 1), gr AS (SELECT run_id, day FROM rr JOIN dd ON dd.day >= rr.d0),
mv AS (SELECT run_id, CAST(occurred_at AS DATE) AS day, sum(CASE WHEN side = 'BUY' THEN -(gross_amount + fee) ELSE gross_amount - fee END) AS cd FROM bk GROUP BY 1, 2),
ch AS (SELECT gr.run_id, gr.day, 100000000 + sum(coalesce(cd, 0)) OVER (PARTITION BY gr.run_id ORDER BY gr.day) AS cash FROM gr LEFT JOIN mv ON mv.run_id = gr.run_id AND mv.day = gr.day),
pq AS (SELECT run_id, instrument_id, CAST(occurred_at AS DATE) AS day, arg_max(held_after, (occurred_at, order_id, line_no, part_id, gross0)) AS q FROM bk GROUP BY 1, 2, 3),
gi AS (SELECT gr.run_id, gr.day, i.instrument_id FROM gr JOIN (SELECT DISTINCT run_id, instrument_id FROM bk) i USING (run_id)),
gh AS (SELECT gi.*, pq.q FROM gi ASOF JOIN pq ON gi.run_id = pq.run_id AND gi.instrument_id = pq.instrument_id AND gi.day >= pq.day),
gv AS (SELECT gh.run_id, gh.day, sum(round_even(CAST(q AS DECIMAL(28,8)) * mark, 8)) AS pv FROM gh ASOF JOIN mk ON gh.instrument_id = mk.instrument_id AND gh.day >= mk.day WHERE q > 0 GROUP BY 1, 2),
dc AS (SELECT ch.run_id, ch.day, cash, cash + coalesce(pv, 0) AS equity FROM ch LEFT JOIN gv ON gv.run_id = ch.run_id AND gv.day = ch.day),
dr AS (SELECT *, CAST(equity AS DOUBLE) AS e, CAST(max(equity) OVER (PARTITION BY run_id ORDER BY day) AS DOUBLE) AS pk, CAST(lag(equity) OVER (PARTITION BY run_id ORDER BY day) AS DOUBLE) AS pe FROM dc),
dx AS (SELECT run_id, arg_min(equity, day) AS s, arg_max(equity, day) AS l, min((e - pk) / pk * 100) AS dd, count(*) AS n, avg(round_even((e - pe) / pe, 8)) AS m, stddev_samp(round_even((e - pe) / pe, 8)) AS sd FROM dr GROUP BY 1)
"""


#: Fills and points of whole runs that one task takes, and the points that a run has at the most: calendar days of seven years.
_DAILY_ROWS, _RUN_DAYS = 750_000, 2_500


@query(
    "daily_metrics",
    f"""WITH {BOOK}, {_DAILY} SELECT run_id, {Q.num("round_even(CAST(l - s AS DOUBLE) / CAST(s AS DOUBLE) * 100, 8)")} AS "totalReturnPct", {Q.num("round_even(least(dd, 0), 8)")} AS "maxDrawdownPct", {Q.num("round_even(m / nullif(sd, 0) * sqrt(252), 8)")} AS sharpe,
      {Q.num("round_even(sd * sqrt(252) * 100, 8)")} AS "annualizedVolatilityPct", {Q.money("s")} AS "startingEquity", {Q.money("l")} AS "endingEquity", n AS "valuationPointCount" FROM dx""",
)
def daily_metrics(spark, folder):
    """Return, drawdown, Sharpe ratio and volatility over the daily marked curve of every run, up to the last day of all."""
    log = fill_log(spark, folder)
    day = F.to_date("occurred_at")
    unit = F.bround(F.col("gross_amount") / F.col("quantity"), 8).cast("decimal(18,8)")
    marks = cut_lineage(V.daily_marks(log.withColumn("px", unit), FILL_ORDER, "px", day))

    few = V.few_marks(marks)

    def metrics(part, whole):
        booked = _book(part, whole)
        if whole and few:
            return V.curve_metrics(V.daily_curve_of_runs(booked, FILL_ORDER, marks, INITIAL_CASH), V.DAILY, "day", None)
        curve = V.daily_curve(cut_lineage(booked) if whole else booked, FILL_ORDER, marks, INITIAL_CASH)
        return V.curve_metrics(cut_lineage(curve), V.DAILY, "day", "year")

    wide = _per_run(spark, folder, metrics, _DAILY_ROWS, _RUN_DAYS)
    return wide.select(
        "run_id", *[num(c).alias(c) for c in ("totalReturnPct", "maxDrawdownPct", "sharpe", "annualizedVolatilityPct")], money("startingEquity").alias("startingEquity"), money("endingEquity").alias("endingEquity"), "valuationPointCount"
    )


@query(
    "equity_curve_closed",
    f"""WITH {FIFO}, lev AS (SELECT run_id, occurred_at AS as_of, sum(cash_delta) AS cd, sum(cost_basis * sgn) AS bd FROM fb GROUP BY 1, 2),
    pt AS (SELECT run_id, as_of, 100000000 + sum(cd) OVER w AS cash, sum(bd) OVER w AS position_value FROM lev WINDOW w AS (PARTITION BY run_id ORDER BY as_of)
      UNION ALL SELECT run_id, min(as_of) - INTERVAL 1 MICROSECOND, 100000000, 0 FROM lev GROUP BY 1
      UNION ALL SELECT run_id, (SELECT max(as_of) + INTERVAL 1 DAY FROM lev), 100000000 + sum(cd), sum(bd) FROM lev GROUP BY 1)
    SELECT run_id, as_of, {Q.money("cash")} AS cash, {Q.money("position_value")} AS position_value, {Q.money("cash + position_value")} AS equity FROM pt""",
)
def equity_curve_closed(spark, folder):
    """The curve at cost with its closing point, a day after the last fill of all runs."""
    events = cut_lineage(_per_run(spark, folder, lambda log, whole: L.ledger_events(_basis(log, whole))))
    through = events.select(F.max("as_of") + F.expr("INTERVAL 1 DAY")).scalar()
    curve = L.by_size(events, lambda part, whole: V.equity_curve_cost(part, INITIAL_CASH, None if whole else "week", through))
    return curve.select("run_id", "as_of", money("cash").alias("cash"), money("position_value").alias("position_value"), money("equity").alias("equity"))


# ---------------------------------------------------------------- detail bundles

_DETAIL_IDS = ["order_id", "line_no", "part_id", "instrument_id"]
_TREE = f"""{CURVE},
en AS (SELECT *, 'SECURITY' AS account, CASE WHEN side = 'BUY' THEN 'DEBIT' ELSE 'CREDIT' END AS direction, cost_basis AS amount FROM fb UNION ALL SELECT *, 'FEE', 'DEBIT', fee FROM fb
  UNION ALL SELECT *, 'CASH', CASE WHEN cash_delta < 0 THEN 'CREDIT' ELSE 'DEBIT' END, abs(cash_delta) FROM fb UNION ALL SELECT *, 'REALIZED_PNL', CASE WHEN realized_pnl >= 0 THEN 'CREDIT' ELSE 'DEBIT' END, abs(realized_pnl) FROM fb WHERE side = 'SELL'),
da AS (SELECT run_id, 'TRADE' AS record_type, occurred_at, {_fields(*_DETAIL_IDS)} AS record_id FROM fb UNION ALL SELECT run_id, 'POSITION', occurred_at, {_fields("instrument_id", "order_id", "line_no", "part_id")} FROM fb
  UNION ALL SELECT run_id, 'LEDGER', occurred_at, {_fields(*_DETAIL_IDS, "account", "direction")} FROM en WHERE amount <> 0
  UNION ALL SELECT run_id, 'CALCULATION', as_of, {_fields("epoch_us(as_of)")} FROM cv),
dw AS (SELECT *, {_WEEK.format(ts="occurred_at")} AS week_start FROM da),
dn AS (SELECT *, (row_number() OVER (PARTITION BY run_id, record_type, week_start ORDER BY occurred_at, record_id) - 1) // 50 + 1 AS part FROM dw),
dp AS (SELECT run_id, record_type, week_start, part, count(*) AS row_count, sha256(string_agg(record_id, chr(10) ORDER BY occurred_at, record_id)) AS digest FROM dn GROUP BY ALL),
t1 AS (SELECT run_id, record_type, week_start, 'WEEK' AS level, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS digest, CAST(sum(row_count) AS BIGINT) AS row_count FROM dp GROUP BY ALL),
t2 AS (SELECT run_id, record_type, CAST(NULL AS DATE) AS week_start, 'TYPE' AS level, sha256(string_agg(strftime(week_start, '%Y-%m-%d') || ':' || digest, chr(10) ORDER BY week_start)) AS digest, CAST(sum(row_count) AS BIGINT) AS row_count FROM t1 GROUP BY ALL),
t3 AS (SELECT run_id, CAST(NULL AS VARCHAR) AS record_type, CAST(NULL AS DATE) AS week_start, 'BUNDLE' AS level,
  sha256(string_agg(record_type || ':' || digest, chr(10) ORDER BY list_position(['TRADE', 'POSITION', 'LEDGER', 'CALCULATION'], record_type))) AS digest, CAST(sum(row_count) AS BIGINT) AS row_count FROM t2 GROUP BY ALL)
"""


@query("detail_bundles", f"WITH {FIFO}, {_TREE} SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3")
def detail_bundles(spark, folder):
    """Trade, position, ledger and calculation rows in weekly parts of fifty, and the hash tree over them up to each run's bundle."""
    return _per_run(spark, folder, lambda log, whole: (_bundles_of_runs if whole else _bundles)(_basis(log, whole)), _BUNDLE_FILLS)


_PART = 50
#: Fills of whole runs that one task takes; each has up to seven records.
_BUNDLE_FILLS = 200_000
_POSITION_IDS = ["instrument_id", "order_id", "line_no", "part_id"]


def _bundles(fills):
    """The tree of runs that have to be spread."""
    states = fills.withColumn("basis", F.col("cost_basis"))
    entries = L.ledger_entries(fills, [*ID, "occurred_at"])
    curve = cut_lineage(V.equity_curve_cost(cut_lineage(L.ledger_events(fills)), INITIAL_CASH, "week").select("run_id", "as_of", F.unix_micros("as_of").alias("instant"), "equity"))
    kinds = [
        D.detail_rows(fills, "TRADE", "occurred_at", _DETAIL_IDS, ["side", "executed", "gross_amount", "fee"]),
        D.detail_rows(states, "POSITION", "occurred_at", _POSITION_IDS, ["held_after", "basis"]),
        D.detail_rows(entries, "LEDGER", "occurred_at", [*_DETAIL_IDS, "account", "direction"], ["amount"]),
        D.detail_rows(curve, "CALCULATION", "as_of", ["instant"], ["equity"]),
    ]
    # The tree covers identities only. The rows are read off the stored fills and curve each time, not stored once more.
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]).drop("payload")
    numbered = D.number_parts(D.assign_week(rows, "occurred_at"), "occurred_at", ["record_id"], _PART)
    return D.bundle_tree(D.part_manifest(numbered, "occurred_at", "record_id"))


def _bundles_of_runs(fills):
    """The same tree of bounded runs: a fill carries its records, which are sorted and hashed where its run was sent."""
    named = fills.select(
        "*", F.col("occurred_at").alias("as_of"), L.cash_delta().alias("cash_delta"), L.basis_delta().alias("basis_delta"),
        joined_fields(_DETAIL_IDS).alias("_trade"), joined_fields(_POSITION_IDS).alias("_position"), L.entry_list().alias("_entries"),
    )
    named = named.withColumns({f"_e{i}": F.get("_entries", F.lit(i)) for i in range(L.MOST_ENTRIES)})
    ledger = [F.when(F.col(f"_e{i}.amount") != 0, F.concat("_trade", joined_fields([f"_e{i}.account", f"_e{i}.direction"]))).alias(f"_l{i}") for i in range(L.MOST_ENTRIES)]
    moves = named.select("run_id", "as_of", "cash_delta", "basis_delta", "_trade", "_position", *ledger)
    ids = ["_trade", "_position", *[f"_l{i}" for i in range(L.MOST_ENTRIES)]]
    points = D.assign_week(V.with_points(moves, INITIAL_CASH, ids).withColumn("instant", F.unix_micros("as_of")), "as_of")
    point = F.when(F.col("is_point"), joined_fields(["instant"]))

    def records(*names):
        return F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.col("as_of").alias("t"), c.alias("i"))) for c in names]))

    kinds = {"TRADE": [F.col("_trade")], "POSITION": [F.col("_position")], "LEDGER": [F.col(c) for c in ids[2:]], "CALCULATION": [point]}
    return D.bundles_of_runs(points.select("run_id", "week_start", *[records(*c).alias(kind) for kind, c in kinds.items()]), _PART)


# ---------------------------------------------------------------- verified scans


@query(
    "verified_scan",
    f"""{_MARKET_SQL}, f AS (SELECT instrument_id, count(*) AS n, CASE instrument_id WHEN 'view' THEN 'ROW_COUNT' WHEN 'click' THEN 'PERIOD' WHEN 'error' THEN 'MISSING' END AS finding FROM bars GROUP BY 1)
    SELECT instrument_id, finding, CASE WHEN finding IS NULL THEN n ELSE 0 END AS rows_read FROM f""",
)
def verified_scan(spark, folder):
    """Bars written as one object per instrument, declared in a JSON manifest with three wrong entries, verified from the objects'
    footers; only the good objects are read."""
    path = _store(spark)
    bars = _bar_dataset(spark, folder)
    bars.repartition("instrument_id").withColumn("shard", F.col("instrument_id")).write.partitionBy("shard").parquet(f"{path}/objects")
    read = market.utc(spark).read.parquet(f"{path}/objects").select("*", F.col("_metadata.file_path").alias("object_key"))
    objects = read.groupBy("object_key", F.col("instrument_id").alias("shard_key")).agg(F.count(F.lit(1)).alias("row_count"), F.min("bar_start_at").alias("period_start"), (F.max("bar_start_at") + F.expr("INTERVAL 30 MINUTES")).alias("period_end"))
    wrong = objects.withColumns(
        {
            "row_count": F.when(F.col("shard_key") == "view", F.col("row_count") + 1).otherwise(F.col("row_count")),
            "period_end": F.when(F.col("shard_key") == "click", F.col("period_start") + F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("period_end")),
            "object_key": F.when(F.col("shard_key") == "error", F.concat("object_key", F.lit(".gone"))).otherwise(F.col("object_key")),
        }
    )
    declared = wrong.agg(F.collect_list(F.struct("object_key", "shard_key", "row_count", "period_start", "period_end")).alias("objects")).withColumn("manifest_id", F.lit("m1"))
    declared.write.json(f"{path}/manifests")
    listed = market.manifest_objects(market.read_manifests(spark, f"{path}/manifests")).select(F.col("object_key").alias("path"), "shard_key", "row_count", F.col("period_start").cast("timestamp"), F.col("period_end").cast("timestamp"))
    checked = cut_lineage(verified.verify_objects(listed, verified.footers(listed, "bar_start_at")))
    rows = verified.scan_verified(spark, checked, BARS).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows_read"))
    return checked.join(rows, checked["shard_key"] == rows["instrument_id"], "left").select(checked["shard_key"].alias("instrument_id"), "finding", F.coalesce("rows_read", F.lit(0)).cast("long").alias("rows_read"))


@query("step_observer", f"""{_MARKET_SQL} SELECT 'bars' AS step, count(*) AS rows_out, count(DISTINCT instrument_id) > 0 AS any_rows, CAST(sum(volume) AS BIGINT) AS volume FROM bars
    UNION ALL SELECT 'rising', count(*), count(*) > 0, CAST(sum(volume) AS BIGINT) FROM bars WHERE close > open""")
def step_observer(spark, folder):
    """Counts of two steps, gathered by the one job that writes the result."""
    counts = {"rows_out": F.count(F.lit(1)), "volume": F.sum("volume")}
    bars, first = verified.observed(event_bar_events(spark, folder), "bars", **counts)
    rising, second = verified.observed(bars.filter("close > open"), "rising", **counts)
    rising.write.format("noop").mode("overwrite").save()
    seen = [(name, watch.get["rows_out"], watch.get["rows_out"] > 0, watch.get["volume"]) for name, watch in (("bars", first), ("rising", second))]
    return spark.createDataFrame(seen, "step string, rows_out long, any_rows boolean, volume long")
