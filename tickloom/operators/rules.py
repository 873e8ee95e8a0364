"""Rule evaluation.

A rule is a function of its arguments that returns a three-valued Column: TRUE, FALSE or NULL (input missing). Rules are
plain Column expressions, so a chain of them costs one projection; later steps never change an earlier failure.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import COMPARATORS
from tickloom.operators import indicators as I
from tickloom.operators.scan import Running, prefix_scan


@dataclass(frozen=True)
class Rule:
    """``passed`` is the truth value; ``error`` marks rows on which the rule cannot be computed at all."""

    passed: Column
    error: Column | None = None


Args = Mapping[str, object]


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def price_compare(a: Args) -> Rule:
    """close op reference column."""
    return Rule(COMPARATORS[str(a["operator"])](_double("close"), _double(str(a["column"]))))


def price_change_percent(a: Args) -> Rule:
    base = _double(str(a["column"]))
    change = F.try_divide((_double("close") - base) * 100.0, base)
    limit = float(a["thresholdPercent"])  # type: ignore[arg-type]
    passed = change >= limit if a["direction"] == "UP" else change <= -limit
    return Rule(passed, base == 0)


def volume_compare(a: Args) -> Rule:
    """volume op reference * multiplier."""
    expected = _double(str(a["column"])) * float(a["multiplier"])  # type: ignore[arg-type]
    return Rule(COMPARATORS[str(a["operator"])](_double("volume"), expected))


def streak(a: Args) -> Rule:
    need = int(a["bars"])  # type: ignore[call-overload]
    return Rule(F.when(F.col("pos") > need, F.col(str(a["column"])) >= need))


def sma_cross(a: Args) -> Rule:
    """Averages compared as exact sums: short/s <= long/l is short*l <= long*s."""
    s, lng = int(a["shortPeriod"]), int(a["longPeriod"])  # type: ignore[call-overload]
    cs, cl = F.col(f"sum_{s}") * lng, F.col(f"sum_{lng}") * s
    ps, pl = F.col(f"sum_{s}_prev") * lng, F.col(f"sum_{lng}_prev") * s
    if a["direction"] == "UP":
        return Rule((ps <= pl) & (cs > cl) | (F.lit(None) & pl.isNull()))
    return Rule((ps >= pl) & (cs < cl) | (F.lit(None) & pl.isNull()))


def _cross_level(previous: Column, current: Column, level: float, direction: object) -> Column:
    passed = (previous <= level) & (current > level) if direction == "UP" else (previous >= level) & (current < level)
    return F.when(previous.isNotNull() & current.isNotNull(), passed)


def rsi_cross(a: Args) -> Rule:
    return Rule(_cross_level(_double("rsi_previous"), _double("rsi_current"), float(a["threshold"]), a["direction"]))  # type: ignore[arg-type]


def macd_cross(a: Args) -> Rule:
    return Rule(_cross_level(F.col("prev_histogram"), F.col("histogram"), 0.0, a["direction"]))


def bollinger_reversal(a: Args) -> Rule:
    n, k = int(a["period"]), float(a["deviations"])  # type: ignore[arg-type, call-overload]
    width, before = F.col(f"band_dev_{n}") * k, F.col(f"band_dev_{n}_prev") * k
    mid, mid_before = F.col(f"band_mid_{n}"), F.col(f"band_mid_{n}_prev")
    if a["direction"] == "UP":
        passed = (_double("prev_close") <= mid_before - before) & (_double("close") > mid - width)
    else:
        passed = (_double("prev_close") >= mid_before + before) & (_double("close") < mid + width)
    return Rule(F.when(before.isNotNull(), passed))


def position_return(a: Args) -> Rule:
    limit = float(a["thresholdPercent"])  # type: ignore[arg-type]
    value = _double("return_percent")
    return Rule(value >= limit if a["direction"] == "PROFIT" else value <= -limit)


def holding_period(a: Args) -> Rule:
    if a["unit"] == "SESSION_CLOSE":
        return Rule(F.col("session_close"))
    column = "holding_bars" if a["unit"] == "BAR" else "holding_days"
    return Rule(F.col(column) >= int(a["amount"]))  # type: ignore[call-overload]


def peak_return(a: Args) -> Rule:
    return Rule(COMPARATORS[str(a["operator"])](_double("peak_return_percent"), F.lit(float(a["thresholdPercent"]))))  # type: ignore[arg-type]


def drawdown_from_peak(a: Args) -> Rule:
    return Rule(COMPARATORS[str(a["operator"])](_double("drawdown_percent"), F.lit(float(a["thresholdPercent"]))))  # type: ignore[arg-type]


def schedule(a: Args) -> Rule:
    every = int(a.get("interval", 1))  # type: ignore[call-overload]
    return Rule(
        {
            "EVERY_TRADING_DAY": F.col("new_trading_day"),
            "WEEK_FIRST_TRADING_DAY": F.col("week_first_day"),
            "MONTH_FIRST_TRADING_DAY": F.col("month_first_day"),
            "MONTH_LAST_TRADING_DAY": F.col("month_last_day"),
            "EVERY_N_TRADING_DAYS": F.col("new_trading_day") & ((F.col("trading_day_index") - 1) % every == 0),
        }[str(a["cycle"])]
    )


def compare_value(a: Args) -> Rule:
    """LOAD_FEATURE followed by COMPARE: any value column against a threshold."""
    return Rule(COMPARATORS[str(a["operator"])](_double(str(a["column"])), F.lit(float(a["threshold"]))))  # type: ignore[arg-type]


# The registry is the extension point: user rules are added as functions from arguments to a Rule.
RULES: dict[str, Callable[[Args], Rule]] = {
    "COMPARE": compare_value,
    "PRICE_COMPARE": price_compare,
    "PRICE_CHANGE_PERCENT": price_change_percent,
    "VOLUME_COMPARE": volume_compare,
    "STREAK": streak,
    "SMA_CROSS": sma_cross,
    "RSI_CROSS": rsi_cross,
    "MACD_CROSS": macd_cross,
    "BOLLINGER_REVERSAL": bollinger_reversal,
    "POSITION_RETURN": position_return,
    "HOLDING_PERIOD": holding_period,
    "PEAK_RETURN": peak_return,
    "DRAWDOWN_FROM_PEAK": drawdown_from_peak,
    "SCHEDULE": schedule,
}

UNGATED = {"HOLDING_PERIOD", "SCHEDULE"}


def register_rule(operation: str, build: Callable[[Args], Rule]) -> None:
    RULES[operation] = build


@dataclass(frozen=True)
class Step:
    operation: str
    arguments: Mapping[str, object]


def step_columns(step: Step, bar_closed: Column | None) -> tuple[Column, Column]:
    """(outcome code, reason). Codes: 1 passed, 0 failed, NULL missing, -1 error."""
    rule = RULES[step.operation](step.arguments)
    code = F.when(rule.passed, 1).when(~rule.passed, 0)
    if rule.error is not None:
        code = F.when(rule.error, -1).otherwise(code)
    name = step.operation
    reason = (
        F.when(code == 1, f"{name}_TRUE").when(code == 0, f"{name}_FALSE").when(code == -1, "CONDITION_ERROR").otherwise("FEATURE_WARMUP_INCOMPLETE")
    )
    if bar_closed is not None and name not in UNGATED:
        reason = F.when(~bar_closed, "WAITING_FOR_BAR_CLOSE").otherwise(reason)
        code = F.when(~bar_closed, 0).otherwise(code)
    return code, reason


def evaluate_chain(df: DataFrame, steps: Sequence[Step], bar_closed: Column | None = None, trace: bool = True) -> DataFrame:
    """AND chain with first-failure semantics.

    Adds ``status`` (CANDIDATE, CONDITION_NOT_MET, INPUT_MISSING, CONDITION_ERROR), ``first_failure_step``,
    ``first_failure_reason`` and the ``trace`` of the steps up to the first failure.
    """
    built = [step_columns(s, bar_closed) for s in steps]
    staged = df.withColumns({f"_o{i}": code for i, (code, _) in enumerate(built)})
    staged = staged.withColumns({f"_r{i}": reason for i, (_, reason) in enumerate(built)})
    failed = F.coalesce(
        *[
            F.when(
                ~F.coalesce(F.col(f"_o{i}") == 1, F.lit(False)),
                F.struct(
                    F.lit(i + 1).alias("step"),
                    F.col(f"_r{i}").alias("reason"),
                    F.when(F.col(f"_o{i}") == 0, "CONDITION_NOT_MET").when(F.col(f"_o{i}") == -1, "CONDITION_ERROR").otherwise("INPUT_MISSING").alias("status"),
                ),
            )
            for i in range(len(built))
        ]
    )
    staged = staged.withColumn("_f", failed)
    result = staged.withColumns(
        {
            "status": F.coalesce(F.col("_f.status"), F.lit("CANDIDATE")),
            "first_failure_step": F.col("_f.step"),
            "first_failure_reason": F.col("_f.reason"),
        }
    )
    if trace:
        entries = F.array(
            *[
                F.struct(F.lit(i + 1).alias("step"), (F.col(f"_o{i}") == 1).alias("passed"), F.col(f"_r{i}").alias("reason"))
                for i in range(len(built))
            ]
        )
        result = result.withColumn(
            "trace", F.filter(entries, lambda e: e["step"] <= F.coalesce(F.col("first_failure_step"), F.lit(len(built))))
        )
    return result.drop("_f", *[f"_o{i}" for i in range(len(built))], *[f"_r{i}" for i in range(len(built))])


def evaluate_flows(df: DataFrame, flows: Mapping[str, Sequence[Step]], bar_closed: Column | None = None) -> DataFrame:
    """Several flows over the same bars in one pass: one output row per (bar, flow)."""
    outcome = []
    for flow, steps in flows.items():
        codes = [step_columns(s, bar_closed) for s in steps]
        first = F.coalesce(
            *[
                F.when(
                    ~F.coalesce(code == 1, F.lit(False)),
                    F.struct(
                        F.lit(flow).alias("flow_id"),
                        F.when(code == 0, "CONDITION_NOT_MET").when(code == -1, "CONDITION_ERROR").otherwise("INPUT_MISSING").alias("status"),
                        F.lit(i + 1).alias("first_failure_step"),
                        reason.alias("first_failure_reason"),
                    ),
                )
                for i, (code, reason) in enumerate(codes)
            ],
            F.struct(
                F.lit(flow).alias("flow_id"),
                F.lit("CANDIDATE").alias("status"),
                F.lit(None).cast("int").alias("first_failure_step"),
                F.lit(None).cast("string").alias("first_failure_reason"),
            ),
        )
        outcome.append(first)
    return df.select("*", F.explode(F.array(*outcome)).alias("_d")).select(*df.columns, "_d.*")


def equal_allocation(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surviving BUY candidates of one flow at one instant each get exactly 1/n, kept as two integers.

    The count is an aggregate joined back, so an instant with very many instruments needs no single-task window.
    """
    counts = decisions.filter("status = 'CANDIDATE' AND side = 'BUY'").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    got = (F.col("status") == "CANDIDATE") & (F.col("side") == "BUY")
    return (
        decisions.join(counts, list(keys), "left")
        .withColumn("alloc_num", F.when(got, 1))
        .withColumn("alloc_den", F.when(got, F.col("_n")))
        .drop("_n")
    )


def condition_outcomes(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flatten traces to (condition_id, passed) in decision order; a decision without trace gives one failing row."""
    fallback = F.array(F.struct(F.lit(0).alias("step"), F.lit(False).alias("passed"), F.col("first_failure_reason").alias("reason")))
    steps = F.when(F.coalesce(F.size("trace"), F.lit(0)) > 0, F.col("trace")).otherwise(fallback)
    return decisions.select(*keys, F.explode(steps).alias("_s")).select(
        *keys,
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys[:2]], F.col("_s.step").cast("string")).alias("condition_id"),
        F.col("_s.step").alias("ordinal"),
        F.coalesce(F.col("_s.passed"), F.lit(False)).alias("passed"),
    )


def skip_reason(allowed: Column, data_available: Column, session_status: Column) -> Column:
    return (
        F.when(~allowed, "DATA_GAP_EVALUATION_SKIPPED").when(~data_available, "DATA_UNAVAILABLE").when(session_status != "REGULAR_OPEN", session_status)
    )


def requirements(rules: DataFrame) -> DataFrame:
    """Earliest warm-up per series: start minus the longest lookback times the period."""
    back = F.timestamp_micros(F.unix_micros("period_start") - F.col("lookback").cast("long") * F.col("period_seconds") * F.lit(1_000_000))
    return rules.groupBy("instrument_id", "data_kind", "resolution").agg(F.min(back).alias("warmup_from"), F.max("lookback").alias("bars"))


def resolve_flow_clock(flows: DataFrame) -> DataFrame:
    """A flow without own resolution takes the only resolution of the flows that share an instrument.

    Distinct (instrument, resolution) pairs are few per instrument, so hot instruments do not multiply rows.
    """
    own = flows.filter(F.col("resolution").isNotNull()).select("instrument_id", "resolution").distinct()
    needing = flows.filter(F.col("resolution").isNull()).select("flow_id", "instrument_id").distinct()
    found = needing.join(own, "instrument_id", "left").groupBy("flow_id").agg(
        F.count_distinct("resolution").alias("_n"), F.min("resolution").alias("_r")
    )
    return found.select(
        "flow_id",
        F.when(F.col("_n") == 1, F.col("_r")).alias("resolution"),
        F.when(F.col("_n") == 1, "INHERITED").when(F.col("_n") == 0, "NO_CLOCK").otherwise("AMBIGUOUS").alias("finding"),
    )


def standard_indicators(short: int = 5, long: int = 20, period: int = 20) -> dict[str, I.Indicator]:
    """The indicator columns the built-in rules read."""
    return {
        "prev_close": I.prev_close(),
        "prev_volume": I.prev_volume(),
        f"sum_{short}": I.close_sum(short),
        f"sum_{short}_prev": I.close_sum(short, 1),
        f"sum_{long}": I.close_sum(long),
        f"sum_{long}_prev": I.close_sum(long, 1),
        f"sma_{period}": I.sma(period),
        f"high_{period}": I.high(period),
        f"low_{period}": I.low(period),
        f"avg_volume_{period}": I.avg_volume(period),
        "streak_up": I.streak("UP"),
        "streak_down": I.streak("DOWN"),
        "rsi": I.rsi(14),
        f"band_mid_{period}": I.band_mean(period),
        f"band_mid_{period}_prev": I.band_mean(period, 1),
        f"band_dev_{period}": I.band_deviation(period),
        f"band_dev_{period}_prev": I.band_deviation(period, 1),
    }


def threshold_hits(rules: DataFrame, values: DataFrame, width: float) -> DataFrame:
    """Evaluated and passed bars of comparison rules (rule_id, instrument_id, op, threshold) over values.

    Rules and distinct values of an instrument are merged on one number line; a running count of values below and at each
    threshold answers all six comparators, so many rules over many bars cost one ordered scan.
    """
    keys = ["instrument_id"]
    points = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("value").alias("at"), F.lit(0).alias("side"), "n", F.lit(None).alias("rule"))
    marks = rules.select(*keys, F.col("threshold").alias("at"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"), F.struct("rule_id", "op").alias("rule"))
    merged = points.unionByName(marks)
    here = F.when(F.col("side") == 0, F.struct("at", "n"))
    scanned = prefix_scan(
        merged, keys, ["at", "side"], F.floor(F.col("at") / F.lit(width)), {"_upto": Running("sum", F.col("n")), "_last": Running("last", here)}
    ).filter("side = 1")
    totals = points.groupBy(*keys).agg(F.sum("n").alias("_all"))
    counted = scanned.join(totals, keys, "left").select(
        F.col("rule.rule_id").alias("rule_id"), *keys, F.col("rule.op").alias("op"), F.coalesce("_all", F.lit(0)).alias("evaluated"), F.col("_upto").alias("lte"),
        F.when(F.col("_last.at") == F.col("at"), F.col("_last.n")).otherwise(0).alias("eq"),
    )
    passed = (
        F.when(F.col("op") == "LT", F.col("lte") - F.col("eq"))
        .when(F.col("op") == "LTE", F.col("lte"))
        .when(F.col("op") == "GT", F.col("evaluated") - F.col("lte"))
        .when(F.col("op") == "GTE", F.col("evaluated") - F.col("lte") + F.col("eq"))
        .when(F.col("op") == "EQ", F.col("eq"))
        .otherwise(F.col("evaluated") - F.col("eq"))
    )
    return counted.select("rule_id", *keys, "evaluated", passed.alias("passed"))


def reference_price(column: str = "close") -> Column:
    return F.bround(F.col(column), 8).cast("decimal(24,8)")
