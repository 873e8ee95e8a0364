"""Indicators, rules, decisions, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import sql as Q
from tickloom.catalog.base import num, query
from tickloom.catalog.inputs import calendar, event_bar_events, supplier_days
from tickloom.functions.scalars import compare, plus_seconds, price
from tickloom.operators import calendar as cal
from tickloom.operators import gates as G
from tickloom.operators import indicators as I
from tickloom.operators import joins as J
from tickloom.operators import rules as R
from tickloom.session import cut_lineage
from tickloom.sources.tables import table

KEY = ["instrument_id"]


def _frame(n: int, offset: int = 0) -> str:
    return f"(PARTITION BY instrument_id ORDER BY starts_at ROWS BETWEEN {n - 1 + offset} PRECEDING AND {offset} PRECEDING)" if offset else (
        f"(PARTITION BY instrument_id ORDER BY starts_at ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


_W = "(PARTITION BY instrument_id ORDER BY starts_at)"
_PREV_N = "(PARTITION BY instrument_id ORDER BY starts_at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def _indicator_sql(source: str) -> str:
    return f"""
i0 AS (SELECT *, row_number() OVER {_W} AS pos, lag(close) OVER {_W} AS prev_close, lag(volume) OVER {_W} AS prev_volume FROM {source}),
i1 AS (SELECT *, close - prev_close AS chg FROM i0),
i2 AS (SELECT *,
  CASE WHEN pos >= 5 THEN sum(close) OVER {_frame(5)} END AS sum_5,
  CASE WHEN pos >= 6 THEN sum(close) OVER {_frame(5, 1)} END AS sum_5_prev,
  CASE WHEN pos >= 20 THEN sum(close) OVER {_frame(20)} END AS sum_20,
  CASE WHEN pos >= 21 THEN sum(close) OVER {_frame(20, 1)} END AS sum_20_prev,
  CASE WHEN pos > 20 THEN max(close) OVER {_PREV_N} END AS high_20,
  CASE WHEN pos > 20 THEN min(close) OVER {_PREV_N} END AS low_20,
  CASE WHEN pos > 20 THEN CAST(sum(volume) OVER {_PREV_N} AS DOUBLE) / 20 END AS avg_volume_20,
  CASE WHEN pos > 14 THEN sum(greatest(chg, 0)) OVER {_frame(14)} END AS gain,
  CASE WHEN pos > 14 THEN sum(greatest(-chg, 0)) OVER {_frame(14)} END AS loss,
  CASE WHEN pos >= 20 THEN stddev_pop(CAST(close AS DOUBLE)) OVER {_frame(20)} END AS dev,
  CASE WHEN pos >= 21 THEN stddev_pop(CAST(close AS DOUBLE)) OVER {_frame(20, 1)} END AS dev_prev,
  least(pos - coalesce(max(CASE WHEN chg > 0 THEN NULL ELSE pos END) OVER {_W}, 0), 179) AS streak_up,
  least(pos - coalesce(max(CASE WHEN chg < 0 THEN NULL ELSE pos END) OVER {_W}, 0), 179) AS streak_down
  FROM i1),
ind AS (SELECT *, CAST(sum_20 AS DOUBLE) / 20 AS sma_20, CAST(sum_20_prev AS DOUBLE) / 20 AS sma_20_prev,
  CASE WHEN gain + loss = 0 THEN 50.0 ELSE round(CAST(gain AS DOUBLE) * 100 / CAST(gain + loss AS DOUBLE), 8) END AS rsi0 FROM i2),
ind2 AS (SELECT *, CASE WHEN pos > 14 THEN rsi0 END AS rsi FROM ind)
"""


_SUP = f"{Q.SUPPLIER_DAYS}, {_indicator_sql('sbars')}"


def _supplier_indicators(spark, folder, names=None):
    wanted = R.standard_indicators()
    if names:
        wanted = {n: wanted[n] for n in names}
    return I.with_indicators(supplier_days(spark, folder), KEY, wanted, bounded=True)


@query(
    "moving_averages",
    f"""WITH {_SUP} SELECT instrument_id, starts_at, pos, {Q.num("prev_close")} AS prev_close, {Q.num("CAST(sum_5 AS DOUBLE) / 5")} AS sma_5,
    {Q.num("sma_20")} AS sma_20 FROM ind2""",
)
def moving_averages(spark, folder):
    bars = supplier_days(spark, folder)
    done = I.with_indicators(bars, KEY, {"prev_close": I.prev_close(), "sma_5": I.sma(5), "sma_20": I.sma(20)}, bounded=True)
    return done.select(*KEY, "starts_at", "pos", num("prev_close").alias("prev_close"), num("sma_5").alias("sma_5"), num("sma_20").alias("sma_20"))


@query(
    "channel_levels",
    f"""WITH {_SUP} SELECT instrument_id, starts_at, {Q.num("high_20")} AS high_20, {Q.num("low_20")} AS low_20,
    {Q.num("avg_volume_20")} AS avg_volume_20, prev_volume FROM ind2""",
)
def channel_levels(spark, folder):
    done = _supplier_indicators(spark, folder, ["high_20", "low_20", "avg_volume_20", "prev_volume"])
    return done.select(*KEY, "starts_at", num("high_20").alias("high_20"), num("low_20").alias("low_20"), num("avg_volume_20").alias("avg_volume_20"), "prev_volume")


@query(
    "streaks",
    f"""WITH {_SUP} SELECT instrument_id, starts_at, CAST(streak_up AS INTEGER) AS streak_up, CAST(streak_down AS INTEGER) AS streak_down FROM ind2""",
)
def streaks(spark, folder):
    return _supplier_indicators(spark, folder, ["streak_up", "streak_down"]).select(*KEY, "starts_at", "streak_up", "streak_down")


@query("rsi_series", f"WITH {_SUP} SELECT instrument_id, starts_at, {Q.num('rsi')} AS rsi FROM ind2")
def rsi_series(spark, folder):
    return _supplier_indicators(spark, folder, ["rsi"]).select(*KEY, "starts_at", num("rsi").alias("rsi"))


@query(
    "bollinger_bands",
    f"""WITH {_SUP} SELECT instrument_id, starts_at, {Q.num("sma_20 - 2 * dev")} AS lower_band, {Q.num("sma_20 + 2 * dev")} AS upper_band FROM ind2""",
)
def bollinger_bands(spark, folder):
    done = _supplier_indicators(spark, folder, ["band_mid_20", "band_dev_20"])
    return done.select(
        *KEY, "starts_at", num(F.col("band_mid_20") - 2 * F.col("band_dev_20")).alias("lower_band"), num(F.col("band_mid_20") + 2 * F.col("band_dev_20")).alias("upper_band")
    )


def _fold(values: str, n: int) -> str:
    a = f"(2.0::DOUBLE / {n + 1})"
    return f"list_reduce({values}, lambda acc, x: x * {a} + acc * (1 - {a}))"


_EMA_PATH = "list_transform(range(1, len({v}) + 1), lambda k: list_reduce(list_slice({v}, 1, k), lambda acc, x: x * {a} + acc * (1 - {a})))"


@query(
    "ema_series",
    f"""WITH {Q.SUPPLIER_DAYS}, w AS (SELECT instrument_id, starts_at, list(CAST(close AS DOUBLE)) OVER
      (PARTITION BY instrument_id ORDER BY starts_at ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS v FROM sbars)
    SELECT instrument_id, starts_at, {Q.num(_fold("v", 12))} AS ema_12 FROM w""",
)
def ema_series(spark, folder):
    return I.macd(supplier_days(spark, folder), KEY, 12, 26, 9, bounded=True).select(*KEY, "starts_at", num("ema").alias("ema_12"))


_MACD_CTE = f"""w AS (SELECT instrument_id, starts_at, row_number() OVER {_W} AS pos, list(CAST(close AS DOUBLE)) OVER
      (PARTITION BY instrument_id ORDER BY starts_at ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS v FROM {{src}}),
    st AS (SELECT instrument_id, starts_at, pos, list_reduce(list_transform(v, lambda x: {{{{'f': x, 's': x, 'g': 0.0::DOUBLE, 'h': 0.0::DOUBLE, 'p': 0.0::DOUBLE}}}}),
      lambda acc, x: {{{{'f': x.f * (2.0::DOUBLE / 13) + acc.f * (1 - 2.0::DOUBLE / 13), 's': x.f * (2.0::DOUBLE / 27) + acc.s * (1 - 2.0::DOUBLE / 27),
        'g': ((x.f * (2.0::DOUBLE / 13) + acc.f * (1 - 2.0::DOUBLE / 13)) - (x.f * (2.0::DOUBLE / 27) + acc.s * (1 - 2.0::DOUBLE / 27))) * 0.2::DOUBLE + acc.g * 0.8::DOUBLE,
        'h': ((x.f * (2.0::DOUBLE / 13) + acc.f * (1 - 2.0::DOUBLE / 13)) - (x.f * (2.0::DOUBLE / 27) + acc.s * (1 - 2.0::DOUBLE / 27)))
          - (((x.f * (2.0::DOUBLE / 13) + acc.f * (1 - 2.0::DOUBLE / 13)) - (x.f * (2.0::DOUBLE / 27) + acc.s * (1 - 2.0::DOUBLE / 27))) * 0.2::DOUBLE + acc.g * 0.8::DOUBLE),
        'p': acc.h}}}}) AS r FROM w)"""


def _macd_sql(src: str) -> str:
    return _MACD_CTE.format(src=src).replace("{{", "{").replace("}}", "}")


@query(
    "macd_histogram",
    f"""WITH {Q.SUPPLIER_DAYS}, {_macd_sql("sbars")}
    SELECT instrument_id, starts_at, CASE WHEN pos >= 37 THEN {Q.num("r.h", 4)} END AS histogram, CASE WHEN pos >= 37 THEN {Q.num("r.p", 4)} END AS prev_histogram FROM st""",
)
def macd_histogram(spark, folder):
    return I.macd(supplier_days(spark, folder), KEY, 12, 26, 9, bounded=True).select(
        *KEY, "starts_at", num("histogram", 4).alias("histogram"), num("prev_histogram", 4).alias("prev_histogram")
    )


@query(
    "session_opens",
    f"""WITH {Q.CALENDAR}, {Q.TICKS}, {Q.bars(1800)}
    SELECT instrument_id, bar_start_at AS starts_at, {Q.num("first_value(open) OVER (PARTITION BY instrument_id, session_date_et ORDER BY bar_start_at)")} AS session_open FROM bars""",
)
def session_opens(spark, folder):
    bars = event_bar_events(spark, folder).select("instrument_id", "starts_at", "session_date_et", "open")
    return I.session_open(bars, KEY).select(*KEY, "starts_at", num("session_open").alias("session_open"))


# ---------------------------------------------------------------- rules

_RULES = {
    "price_above_sma": R.Step("PRICE_COMPARE", {"operator": "GT", "column": "sma_20"}),
    "price_new_high": R.Step("PRICE_COMPARE", {"operator": "GTE", "column": "high_20"}),
    "price_under_low": R.Step("PRICE_COMPARE", {"operator": "LT", "column": "low_20"}),
    "drop_two_percent": R.Step("PRICE_CHANGE_PERCENT", {"column": "prev_close", "direction": "DOWN", "thresholdPercent": 2}),
    "volume_spike": R.Step("VOLUME_COMPARE", {"operator": "GT", "column": "avg_volume_20", "multiplier": 1.5}),
    "volume_over_previous": R.Step("VOLUME_COMPARE", {"operator": "GTE", "column": "prev_volume", "multiplier": 2}),
    "three_up": R.Step("STREAK", {"column": "streak_up", "direction": "UP", "bars": 3}),
    "cross_up": R.Step("SMA_CROSS", {"shortPeriod": 5, "longPeriod": 20, "direction": "UP"}),
    "cross_down": R.Step("SMA_CROSS", {"shortPeriod": 5, "longPeriod": 20, "direction": "DOWN"}),
    "band_reversal_up": R.Step("BOLLINGER_REVERSAL", {"period": 20, "deviations": 2, "direction": "UP"}),
    "band_reversal_down": R.Step("BOLLINGER_REVERSAL", {"period": 20, "deviations": 2, "direction": "DOWN"}),
    "rsi_below_40": R.Step("COMPARE", {"column": "rsi", "operator": "LT", "threshold": 40}),
}

_RULE_SQL = {
    "price_above_sma": "CAST(close AS DOUBLE) > sma_20",
    "price_new_high": "close >= high_20",
    "price_under_low": "close < low_20",
    "drop_two_percent": "CAST(close - prev_close AS DOUBLE) * 100 / CAST(prev_close AS DOUBLE) <= -2",
    "volume_spike": "volume > avg_volume_20 * 1.5",
    "volume_over_previous": "volume >= prev_volume * 2",
    "three_up": "CASE WHEN pos > 3 THEN streak_up >= 3 END",
    "cross_up": "CASE WHEN pos > 20 THEN sum_5_prev * 20 <= sum_20_prev * 5 AND sum_5 * 20 > sum_20 * 5 END",
    "cross_down": "CASE WHEN pos > 20 THEN sum_5_prev * 20 >= sum_20_prev * 5 AND sum_5 * 20 < sum_20 * 5 END",
    "band_reversal_up": "CASE WHEN pos > 20 THEN CAST(prev_close AS DOUBLE) <= sma_20_prev - 2 * dev_prev AND CAST(close AS DOUBLE) > sma_20 - 2 * dev END",
    "band_reversal_down": "CASE WHEN pos > 20 THEN CAST(prev_close AS DOUBLE) >= sma_20_prev + 2 * dev_prev AND CAST(close AS DOUBLE) < sma_20 + 2 * dev END",
    "rsi_below_40": "rsi < 40",
}


@query(
    "rule_truth",
    f"WITH {_SUP} SELECT instrument_id, starts_at, {', '.join(f'({sql}) AS {name}' for name, sql in _RULE_SQL.items())} FROM ind2",
)
def rule_truth(spark, folder):
    """Truth value of every price, volume and trend rule on every supplier bar."""
    df = _supplier_indicators(spark, folder)
    return df.select(*KEY, "starts_at", *[R.RULES[s.operation](s.arguments).passed.alias(n) for n, s in _RULES.items()])


@query(
    "macd_cross",
    f"""WITH {Q.SUPPLIER_DAYS}, {_macd_sql("sbars")}
    SELECT instrument_id, count(*) FILTER (pos >= 37 AND r.p <= 0 AND r.h > 0) AS up, count(*) FILTER (pos >= 37 AND r.p >= 0 AND r.h < 0) AS down, count(*) FILTER (pos < 37) AS cold
    FROM st GROUP BY 1""",
)
def macd_cross(spark, folder):
    rows = I.macd(supplier_days(spark, folder), KEY, 12, 26, 9, bounded=True)
    up, down = R.macd_cross({"direction": "UP"}).passed, R.macd_cross({"direction": "DOWN"}).passed
    return rows.groupBy(*KEY).agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.count_if(up.isNull()).alias("cold"))


_E30 = f"{Q.CALENDAR}, {Q.TICKS}, {Q.bars(1800)}, {Q.bar_events('30m', 1800)}"
_RSI5 = f"""f0 AS (SELECT *, row_number() OVER {_W} AS pos, close - lag(close) OVER {_W} AS chg FROM ev),
    f1 AS (SELECT *, sum(greatest(chg, 0)) OVER {_frame(14)} AS g, sum(greatest(-chg, 0)) OVER {_frame(14)} AS l FROM f0),
    feat AS (SELECT instrument_id, starts_at AS fs, CAST(round(CASE WHEN g + l = 0 THEN 50.0 ELSE CAST(g AS DOUBLE) * 100 / CAST(g + l AS DOUBLE) END, 8) AS DECIMAL(38,8)) AS value FROM f1 WHERE pos > 14)"""


@query(
    "rsi_cross",
    f"""WITH {_E30}, {_RSI5},
    c AS (SELECT e.instrument_id, e.ends_at, CASE WHEN e.ends_at - f.fs <= INTERVAL 30 MINUTE THEN f.value END AS cur FROM ev e ASOF LEFT JOIN feat f ON e.instrument_id = f.instrument_id AND e.ends_at > f.fs),
    p AS (SELECT c.*, c.ends_at - INTERVAL 30 MINUTE AS b FROM c),
    q AS (SELECT p.instrument_id, p.ends_at, p.cur, CASE WHEN p.b - f.fs <= INTERVAL 30 MINUTE THEN f.value END AS prv FROM p ASOF LEFT JOIN feat f ON p.instrument_id = f.instrument_id AND p.b > f.fs)
    SELECT instrument_id, ends_at AS occurred_at, {Q.num("cur")} AS rsi_current, {Q.num("prv")} AS rsi_previous,
      CASE WHEN cur IS NOT NULL AND prv IS NOT NULL THEN prv <= 50 AND cur > 50 END AS crossed_up FROM q""",
)
def rsi_cross(spark, folder):
    """Pinned RSI at the instant and one clock period earlier; a missing bar is a gap, not the previous session's value."""
    bars = cut_lineage(event_bar_events(spark, folder).select("instrument_id", "starts_at", "occurred_at", "close", "volume"))
    rsi = I.with_indicators(bars, KEY, {"rsi": I.rsi(14)}, bounded=True).filter("rsi IS NOT NULL")
    features = cut_lineage(rsi.select("instrument_id", F.col("starts_at").alias("bar_start_at"), F.col("rsi").cast("decimal(38,8)").alias("value")))
    at = bars.select("instrument_id", "occurred_at")
    now = I.feature_at(at, features, KEY, "occurred_at", 1_800, "rsi_current", bucket=None)
    staged = now.withColumn("_before", plus_seconds("occurred_at", -1_800))
    both = I.feature_at(staged, features, KEY, "_before", 1_800, "rsi_previous", bucket=None)
    crossed = R.rsi_cross({"direction": "UP", "threshold": 50}).passed
    return both.select("instrument_id", "occurred_at", num("rsi_current").alias("rsi_current"), num("rsi_previous").alias("rsi_previous"), crossed.alias("crossed_up"))


@query(
    "schedule_rules",
    f"""WITH {_E30}, f AS (SELECT e.instrument_id, e.ends_at, e.closes_at, s.session_index, s.prev_date, s.next_date, s.session_date,
          e.ends_at = min(e.ends_at) OVER (PARTITION BY instrument_id, s.session_date) AS nd FROM ev e JOIN ses s ON s.session_date = {Q.et_date("e.ends_at")})
    SELECT instrument_id, ends_at AS occurred_at, nd AS every_day, nd AND (session_index - 1) % 3 = 0 AS every_third,
      nd AND date_trunc('week', prev_date) <> date_trunc('week', session_date) AS week_first, ends_at >= closes_at AS at_close FROM f""",
)
def schedule_rules(spark, folder):
    flags = cal.schedule_flags(event_bar_events(spark, folder).select("instrument_id", "occurred_at"), "occurred_at", KEY, calendar(spark))
    rule = lambda **a: R.schedule(a).passed
    return flags.select(
        "instrument_id", "occurred_at",
        rule(cycle="EVERY_TRADING_DAY").alias("every_day"),
        rule(cycle="EVERY_N_TRADING_DAYS", interval=3).alias("every_third"),
        rule(cycle="WEEK_FIRST_TRADING_DAY").alias("week_first"),
        R.holding_period({"unit": "SESSION_CLOSE", "amount": 1}).passed.alias("at_close"),
    )


def wide_range(a: R.Args) -> R.Rule:
    """A rule of the caller's own: the bar's range is at least a share of its close."""
    return R.Rule(F.col("high").cast("double") * 100 - F.col("low").cast("double") * 100 >= F.col("close").cast("double") * float(a["thresholdPercent"]))


@query(
    "bar_close_gate",
    f"""WITH {_E30}, f AS (SELECT e.*, e.ends_at >= e.closes_at AS closed, e.ends_at = min(e.ends_at) OVER (PARTITION BY instrument_id, s.session_date) AS nd,
          CAST(high AS DOUBLE) * 100 - CAST(low AS DOUBLE) * 100 >= CAST(close AS DOUBLE) * 5.0 AS wide, CAST(close AS DOUBLE) >= CAST(open AS DOUBLE) AS rose
        FROM ev e JOIN ses s ON s.session_date = {Q.et_date("e.ends_at")}),
    d AS (SELECT instrument_id, ends_at, 'last' AS flow_id, CASE WHEN NOT closed THEN 'WAITING_FOR_BAR_CLOSE' WHEN NOT wide THEN 'WIDE_RANGE_FALSE' WHEN NOT rose THEN 'PRICE_COMPARE_FALSE' END AS reason, CASE WHEN NOT closed OR NOT wide THEN 1 ELSE 2 END AS step FROM f
      UNION ALL SELECT instrument_id, ends_at, 'first', CASE WHEN NOT nd THEN 'SCHEDULE_FALSE' WHEN NOT closed THEN 'WAITING_FOR_BAR_CLOSE' WHEN NOT rose THEN 'PRICE_COMPARE_FALSE' END, CASE WHEN NOT nd THEN 1 ELSE 2 END FROM f)
    SELECT instrument_id, ends_at AS occurred_at, flow_id, CASE WHEN reason IS NULL THEN 'CANDIDATE' ELSE 'CONDITION_NOT_MET' END AS status,
      CASE WHEN reason IS NOT NULL THEN step END AS first_failure_step, reason AS first_failure_reason FROM d""",
)
def bar_close_gate(spark, folder):
    """Price rules, one of them registered by the caller, wait for the session's last bar; the schedule does not."""
    R.register_rule("WIDE_RANGE", wide_range)
    bars = event_bar_events(spark, folder).select("instrument_id", "occurred_at", "open", "high", "low", "close")
    flags = cal.schedule_flags(bars, "occurred_at", KEY, calendar(spark))
    rose = R.Step("PRICE_COMPARE", {"operator": "GTE", "column": "open"})
    flows = {"last": [R.Step("WIDE_RANGE", {"thresholdPercent": 5}), rose], "first": [R.Step("SCHEDULE", {"cycle": "EVERY_TRADING_DAY"}), rose]}
    return R.evaluate_flows(flags, flows, F.col("session_close")).select("instrument_id", "occurred_at", "flow_id", "status", "first_failure_step", "first_failure_reason")


_FLOWS = {
    "dip": [_RULES["rsi_below_40"], _RULES["drop_two_percent"], _RULES["volume_over_previous"]],
    "trend": [_RULES["cross_up"], _RULES["price_above_sma"]],
    "breakout": [_RULES["price_new_high"], _RULES["volume_spike"], _RULES["three_up"]],
}
_FLOW_SQL = {
    "dip": ["rsi_below_40", "drop_two_percent", "volume_over_previous"],
    "trend": ["cross_up", "price_above_sma"],
    "breakout": ["price_new_high", "volume_spike", "three_up"],
}
_OPS = {n: s.operation for n, s in _RULES.items()}


def _flow_sql(flow: str) -> str:
    steps = _FLOW_SQL[flow]
    first = " ".join(f"WHEN ({_RULE_SQL[s]}) IS NOT TRUE THEN {i + 1}" for i, s in enumerate(steps))
    status = " ".join(
        f"WHEN ({_RULE_SQL[s]}) IS NOT TRUE THEN CASE WHEN ({_RULE_SQL[s]}) IS NULL THEN 'INPUT_MISSING' ELSE 'CONDITION_NOT_MET' END" for s in steps
    )
    reason = " ".join(
        f"WHEN ({_RULE_SQL[s]}) IS NOT TRUE THEN CASE WHEN ({_RULE_SQL[s]}) IS NULL THEN 'FEATURE_WARMUP_INCOMPLETE' ELSE '{_OPS[s]}_FALSE' END" for s in steps
    )
    return f"""SELECT instrument_id, starts_at, '{flow}' AS flow_id, CASE {status} ELSE 'CANDIDATE' END AS status,
      CASE {first} END AS first_failure_step, CASE {reason} END AS first_failure_reason FROM ind2"""


_DECISIONS = " UNION ALL ".join(_flow_sql(f) for f in _FLOWS)


def decisions(spark, folder):
    needed = ["prev_close", "prev_volume", "sum_5", "sum_5_prev", "sum_20", "sum_20_prev", "sma_20", "high_20", "avg_volume_20", "streak_up", "rsi"]
    return R.evaluate_flows(_supplier_indicators(spark, folder, needed), _FLOWS)


@query("flow_decisions", f"WITH {_SUP} SELECT instrument_id, starts_at, flow_id, status, first_failure_step, first_failure_reason FROM ({_DECISIONS})")
def flow_decisions(spark, folder):
    """AND chains of three flows on every bar: status and first failure."""
    return decisions(spark, folder).select("instrument_id", "starts_at", "flow_id", "status", "first_failure_step", "first_failure_reason")


@query(
    "equal_allocation",
    f"""WITH {_SUP}, d AS ({_DECISIONS}), n AS (SELECT flow_id, starts_at, count(*) AS n FROM d WHERE status = 'CANDIDATE' GROUP BY ALL)
    SELECT instrument_id, d.flow_id, d.starts_at, 1 AS alloc_num, n.n AS alloc_den FROM d JOIN n USING (flow_id, starts_at) WHERE status = 'CANDIDATE'""",
)
def equal_allocation(spark, folder):
    rows = decisions(spark, folder).filter("status = 'CANDIDATE'").select("instrument_id", "flow_id", "starts_at", "status", F.lit("BUY").alias("side"))
    return R.equal_allocation(cut_lineage(rows), ["flow_id", "starts_at"]).select("instrument_id", "flow_id", "starts_at", "alloc_num", "alloc_den")


@query(
    "condition_outcomes",
    f"""WITH {_SUP}, o AS (SELECT instrument_id, starts_at, 1 AS ordinal, ({_RULE_SQL['rsi_below_40']}) AS ok, TRUE AS reached FROM ind2
      UNION ALL SELECT instrument_id, starts_at, 2, ({_RULE_SQL['drop_two_percent']}), ({_RULE_SQL['rsi_below_40']}) IS TRUE FROM ind2
      UNION ALL SELECT instrument_id, starts_at, 3, ({_RULE_SQL['volume_over_previous']}), ({_RULE_SQL['rsi_below_40']}) IS TRUE AND ({_RULE_SQL['drop_two_percent']}) IS TRUE FROM ind2)
    SELECT 'dip|' || instrument_id || '|' || ordinal AS condition_id, coalesce(ok, FALSE) AS passed, count(*) AS n FROM o WHERE reached GROUP BY ALL""",
)
def condition_outcomes(spark, folder):
    rows = R.evaluate_chain(_supplier_indicators(spark, folder, ["rsi", "prev_close", "prev_volume"]), _FLOWS["dip"]).withColumn("flow_id", F.lit("dip"))
    flat = R.condition_outcomes(rows, ["flow_id", "instrument_id", "starts_at"])
    return flat.groupBy("condition_id", "passed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rules_on_bars",
    f"""WITH {Q.SUPPLIER_DAYS}, r AS (SELECT 'S' || s_suppkey AS instrument_id, CAST(s_acctbal AS DECIMAL(18,8)) * 10 AS threshold FROM supplier)
    SELECT instrument_id, starts_at, close > threshold AS passed FROM sbars JOIN r USING (instrument_id)""",
)
def rules_on_bars(spark, folder):
    """A table of rules (one threshold per instrument) bound to the bars of its instrument."""
    rules = table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("instrument_id"), (price("s_acctbal") * 10).alias("threshold"), F.lit("GT").alias("op"), F.lit("1d").alias("resolution")
    )
    bars = supplier_days(spark, folder).select("instrument_id", "starts_at", "close", F.lit("1d").alias("resolution"))
    bound = J.bind_rules(rules, bars)
    return bound.select("instrument_id", "starts_at", compare(F.col("op"), F.col("close"), F.col("threshold")).alias("passed"))


@query(
    "threshold_hits",
    f"""WITH {Q.SUPPLIER_DAYS},
    r AS (SELECT p_partkey AS rule_id, 'S' || (p_partkey % (SELECT count(*) FROM supplier)) AS instrument_id,
      CASE p_partkey % 6 WHEN 0 THEN 'LT' WHEN 1 THEN 'LTE' WHEN 2 THEN 'GT' WHEN 3 THEN 'GTE' WHEN 4 THEN 'EQ' ELSE 'NEQ' END AS op,
      CAST(p_retailprice AS DECIMAL(18,8)) * p_size AS threshold FROM part)
    SELECT rule_id, r.instrument_id, count(b.close) AS evaluated, count(*) FILTER (CASE op WHEN 'LT' THEN close < threshold WHEN 'LTE' THEN close <= threshold
      WHEN 'GT' THEN close > threshold WHEN 'GTE' THEN close >= threshold WHEN 'EQ' THEN close = threshold ELSE close <> threshold END) AS passed
    FROM r LEFT JOIN sbars b ON b.instrument_id = r.instrument_id GROUP BY ALL""",
)
def threshold_hits(spark, folder):
    """How often each parameterised comparison holds, many rules per instrument, without forming rule-bar pairs."""
    suppliers = table(spark, folder, "supplier").select(F.count(F.lit(1))).scalar()
    names = ["LT", "LTE", "GT", "GTE", "EQ"]
    op = F.lit("NEQ")
    for i, name in enumerate(names):
        op = F.when(F.col("p_partkey") % 6 == i, name).otherwise(op)
    rules = table(spark, folder, "part").withColumn("_n", suppliers).select(
        F.col("p_partkey").alias("rule_id"),
        F.concat(F.lit("S"), (F.col("p_partkey") % F.col("_n")).cast("string")).alias("instrument_id"),
        op.alias("op"),
        (price("p_retailprice") * F.col("p_size")).cast("decimal(24,8)").alias("threshold"),
    )
    bars = supplier_days(spark, folder).select("instrument_id", F.col("close").cast("decimal(24,8)").alias("value"))
    return R.threshold_hits(rules, bars, 10_000.0)


# ---------------------------------------------------------------- gates

_GATE_ROWS = f"""{Q.SUPPLIER_DAYS},
    c0 AS (SELECT instrument_id, starts_at, row_number() OVER {_W} AS pos, close, lag(close) OVER {_W} AS pc FROM sbars),
    gd AS (SELECT instrument_id, starts_at, pos, CASE WHEN pc IS NULL THEN 'INPUT_MISSING' WHEN close > pc THEN 'CANDIDATE' ELSE 'CONDITION_NOT_MET' END AS status FROM c0)"""


def _gate_rows(spark, folder):
    df = _supplier_indicators(spark, folder, ["prev_close"])
    status = F.when(F.col("prev_close").isNull(), "INPUT_MISSING").when(F.col("close") > F.col("prev_close"), "CANDIDATE").otherwise("CONDITION_NOT_MET")
    return cut_lineage(df.select("instrument_id", "starts_at", "pos", status.alias("status")))


@query(
    "gate_limits",
    f"""WITH {_GATE_ROWS} SELECT instrument_id, starts_at, row_number() OVER (PARTITION BY instrument_id ORDER BY pos) AS execution FROM gd
    WHERE status = 'CANDIDATE' QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY pos) <= 5""",
)
def gate_limits(spark, folder):
    """First five candidates per instrument; the first one alone is the once-only gate."""
    rows = _gate_rows(spark, folder).filter("status = 'CANDIDATE'")
    return G.first_n(rows, KEY, ["pos"], F.floor(F.col("pos") / 4_096), 5).select("instrument_id", "starts_at", "execution")


@query(
    "gate_rearmed",
    f"""WITH {_GATE_ROWS}, a AS (SELECT *, sum(CASE WHEN status = 'CONDITION_NOT_MET' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY pos) AS island FROM gd),
    f AS (SELECT instrument_id, island, min(pos) AS pos, arg_min(starts_at, pos) AS starts_at FROM a WHERE status = 'CANDIDATE' GROUP BY ALL)
    SELECT instrument_id, starts_at, row_number() OVER (PARTITION BY instrument_id ORDER BY pos) AS execution FROM f
    QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY pos) <= 50""",
)
def gate_rearmed(spark, folder):
    return G.rearmed(_gate_rows(spark, folder), KEY, "pos", F.floor(F.col("pos") / 256), 50).select("instrument_id", "starts_at", "execution")


@query(
    "gate_spaced_bars",
    f"""WITH RECURSIVE {_GATE_ROWS}, c AS (SELECT instrument_id, pos, starts_at FROM gd WHERE status = 'CANDIDATE'),
    acc(instrument_id, pos) AS (SELECT instrument_id, min(pos) FROM c GROUP BY 1 UNION ALL
      SELECT acc.instrument_id, min(c.pos) FROM acc JOIN c ON c.instrument_id = acc.instrument_id AND c.pos >= acc.pos + 7 GROUP BY acc.instrument_id, acc.pos)
    SELECT c.instrument_id, c.starts_at FROM acc JOIN c USING (instrument_id, pos)""",
)
def gate_spaced_bars(spark, folder):
    """Wait seven bars between executions."""
    rows = _gate_rows(spark, folder).filter("status = 'CANDIDATE'")
    return G.spaced(rows, KEY, "pos", 7, chunk=256).select("instrument_id", "starts_at")


# ---------------------------------------------------------------- candidates


@query(
    "order_candidates",
    f"""WITH {_E30},
    sk AS (SELECT event_type AS instrument_id, ts AS s, ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) AS e FROM events WHERE value > 60),
    d AS (SELECT instrument_id, ends_at AS decided_at, close, lag(close) OVER {_W} AS pc FROM ev),
    q AS (SELECT d.*, s.session_date, s.opens_at, s.closes_at, s.next_date, s.next_open, s.next_close, NOT EXISTS (SELECT 1 FROM sk WHERE sk.instrument_id = d.instrument_id AND d.decided_at >= sk.s AND d.decided_at < sk.e) AS allowed
      FROM d JOIN ses s ON s.session_date = {Q.et_date("d.decided_at")})
    SELECT instrument_id, decided_at, {Q.num("close")} AS reference_price, CASE WHEN decided_at >= closes_at THEN next_date ELSE session_date END AS session_date_et, CASE WHEN decided_at >= closes_at THEN next_open ELSE decided_at END AS eligible_at,
      CASE WHEN NOT allowed THEN 'DATA_GAP_EVALUATION_SKIPPED' WHEN pc IS NULL THEN 'DATA_UNAVAILABLE' WHEN decided_at >= closes_at THEN 'POST_MARKET' END AS skip_reason FROM q WHERE pc IS NULL OR close > pc""",
)
def order_candidates(spark, folder):
    """Rising bars as BUY candidates with session rule, data-gap stages and skip reasons."""
    bars = event_bar_events(spark, folder).select("instrument_id", "starts_at", "occurred_at", "close", "volume")
    rising = I.with_indicators(bars, KEY, {"prev_close": I.prev_close()}, bounded=True).filter("prev_close IS NULL OR close > prev_close")
    decided = rising.select("instrument_id", F.col("occurred_at").alias("decided_at"), R.reference_price().alias("reference_price"), "prev_close")
    placed = cut_lineage(cal.session_status(cal.eligible_session(decided, "decided_at", calendar(spark)), "decided_at", calendar(spark)))
    skips = table(spark, folder, "events").filter("value > 60").select(
        F.col("event_type").alias("instrument_id"), F.col("ts").alias("starts_at"), F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 60_000_000).cast("long")).alias("ends_at")
    )
    allowed = J.outside(placed, "decided_at", skips, KEY).select(*KEY, "decided_at", F.lit(True).alias("_ok"))
    flagged = placed.join(allowed, [*KEY, "decided_at"], "left")
    reason = R.skip_reason(F.coalesce("_ok", F.lit(False)), F.col("prev_close").isNotNull(), F.col("session_status"))
    return flagged.select("instrument_id", "decided_at", num("reference_price").alias("reference_price"), "session_date_et", "eligible_at", reason.alias("skip_reason"))
