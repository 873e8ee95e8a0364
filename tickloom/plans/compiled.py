"""Jobs over a table of compiled strategy plans (one JSON document per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import PLAN, STEP
from tickloom.session import cut_lineage

TERMINAL = "EMIT_ORDER_CANDIDATE"

# The element catalogue. Values that an argument may take, separated by a bar.
COMPARISONS = "LT|LTE|GT|GTE|EQ|NEQ"
RESOLUTIONS = "30m|1h|4h|1d"
UP_DOWN = "UP|DOWN"
EXECUTION_MODES = "1회만|주기마다|대기 후 재진입|대기 후 재실행"
WAIT_MODES = "조건 재충족|N봉 이후|N거래일 이후"
PRICE_REFERENCES = "PREVIOUS_CLOSE|SESSION_OPEN|AVERAGE_ENTRY_PRICE|SMA_5|SMA_20|SMA_60|HIGH_5|HIGH_20|HIGH_60|LOW_5|LOW_20|LOW_60"
CYCLES = "EVERY_TRADING_DAY|WEEK_FIRST_TRADING_DAY|MONTH_FIRST_TRADING_DAY|MONTH_LAST_TRADING_DAY|EVERY_N_TRADING_DAYS"

# Operation, argument, allowed values (None: any text), whether it is a decimal.
FIRST_ELEMENTS = [
    ("LOAD_FEATURE", "feature", "RSI_14", False),
    ("LOAD_FEATURE", "resolution", "1m", False),
    ("COMPARE", "operator", COMPARISONS, False),
    ("COMPARE", "threshold", None, True),
    (TERMINAL, "allocation", "EQUAL", False),
    (TERMINAL, "orderType", "MARKET", False),
    (TERMINAL, "side", "BUY|SELL", False),
]
ELEMENTS = [
    ("PRICE_COMPARE", "resolution", RESOLUTIONS, False),
    ("PRICE_COMPARE", "operator", COMPARISONS, False),
    ("PRICE_COMPARE", "reference", PRICE_REFERENCES, False),
    ("PRICE_CHANGE_PERCENT", "resolution", RESOLUTIONS, False),
    ("PRICE_CHANGE_PERCENT", "base", "PREVIOUS_CLOSE|SESSION_OPEN|AVERAGE_ENTRY_PRICE", False),
    ("PRICE_CHANGE_PERCENT", "direction", UP_DOWN, False),
    ("PRICE_CHANGE_PERCENT", "thresholdPercent", None, True),
    ("VOLUME_COMPARE", "resolution", RESOLUTIONS, False),
    ("VOLUME_COMPARE", "operator", COMPARISONS, False),
    ("VOLUME_COMPARE", "reference", "PREVIOUS_VOLUME|AVERAGE_VOLUME", False),
    ("VOLUME_COMPARE", "period", "1|5|20|60", False),
    ("VOLUME_COMPARE", "multiplier", "1|2|3", True),
    ("STREAK", "resolution", RESOLUTIONS, False),
    ("STREAK", "direction", UP_DOWN, False),
    ("STREAK", "bars", "2|3|5|10|20|30", False),
    ("SMA_CROSS", "resolution", RESOLUTIONS, False),
    ("SMA_CROSS", "direction", UP_DOWN, False),
    ("SMA_CROSS", "shortPeriod", "5|20|60", False),
    ("SMA_CROSS", "longPeriod", "20|60|120", False),
    ("RSI_CROSS", "resolution", RESOLUTIONS, False),
    ("RSI_CROSS", "direction", UP_DOWN, False),
    ("RSI_CROSS", "period", "14", False),
    ("RSI_CROSS", "threshold", None, True),
    ("MACD_CROSS", "resolution", RESOLUTIONS, False),
    ("MACD_CROSS", "direction", UP_DOWN, False),
    ("MACD_CROSS", "fastPeriod", "12", False),
    ("MACD_CROSS", "slowPeriod", "26", False),
    ("MACD_CROSS", "signalPeriod", "9", False),
    ("BOLLINGER_REVERSAL", "resolution", RESOLUTIONS, False),
    ("BOLLINGER_REVERSAL", "direction", UP_DOWN, False),
    ("BOLLINGER_REVERSAL", "period", "20", False),
    ("BOLLINGER_REVERSAL", "deviations", "2", True),
    ("POSITION_RETURN", "direction", "PROFIT|LOSS", False),
    ("POSITION_RETURN", "thresholdPercent", None, True),
    ("HOLDING_PERIOD", "unit", "SESSION_CLOSE|BAR|TRADING_DAY", False),
    ("HOLDING_PERIOD", "amount", "0|1|5|20", False),
    ("HOLDING_PERIOD", "resolution", RESOLUTIONS, False),
    ("PEAK_RETURN", "operator", COMPARISONS, False),
    ("PEAK_RETURN", "thresholdPercent", None, True),
    ("DRAWDOWN_FROM_PEAK", "operator", COMPARISONS, False),
    ("DRAWDOWN_FROM_PEAK", "thresholdPercent", None, True),
    ("SCHEDULE", "cycle", CYCLES, False),
    ("SCHEDULE", "interval", None, True),
    ("SCHEDULE", "resolution", RESOLUTIONS, False),
    (TERMINAL, "allocation", "EQUAL", False),
    (TERMINAL, "orderType", "MARKET", False),
    (TERMINAL, "timeInForce", "DAY", False),
    (TERMINAL, "side", "BUY|SELL", False),
    (TERMINAL, "orderPercent", None, True),
    (TERMINAL, "executionMode", EXECUTION_MODES, False),
    (TERMINAL, "waitMode", WAIT_MODES, False),
    (TERMINAL, "waitInterval", None, True),
    (TERMINAL, "maxExecutions", None, True),
]

# What the last version adds: lower bound, whether it is excluded, upper bound, whether whole numbers are asked for.
BOUNDS = {
    ("PRICE_CHANGE_PERCENT", "thresholdPercent"): (0, False, None, False),
    ("RSI_CROSS", "threshold"): (0, False, 100, False),
    ("POSITION_RETURN", "thresholdPercent"): (0, False, 100, False),
    ("HOLDING_PERIOD", "amount"): (0, False, None, True),
    ("PEAK_RETURN", "thresholdPercent"): (0, False, 100, False),
    ("DRAWDOWN_FROM_PEAK", "thresholdPercent"): (0, False, 100, False),
    ("SCHEDULE", "interval"): (0, True, None, True),
    (TERMINAL, "orderPercent"): (0, True, 100, False),
    (TERMINAL, "maxPositionPercent"): (0, True, 100, False),
    (TERMINAL, "waitInterval"): (0, True, None, True),
    (TERMINAL, "maxExecutions"): (0, True, None, True),
}
ADDED = [(TERMINAL, "maxPositionPercent", None, True)]

# The versions of the catalogue.
VERSIONS = ("basic-elements:2026-07-31", "basic-elements:2026-08-07", "basic-elements:2026-08-08", "basic-elements:2026-08-25")

SPEC_SCHEMA = "catalogue_version string, operation string, argument string, allowed array<string>, is_decimal boolean, low decimal(38,18), low_excluded boolean, high decimal(38,18), is_whole boolean"


def specs(spark: SparkSession) -> DataFrame:
    """One row per argument of an operation in each version of the catalogue."""
    rows = []
    for version, elements in zip(VERSIONS, (FIRST_ELEMENTS, ELEMENTS, ELEMENTS, ELEMENTS + ADDED), strict=True):
        for operation, argument, allowed, decimal in elements:
            low, excluded, high, whole = BOUNDS.get((operation, argument), (None, False, None, False)) if version == VERSIONS[-1] else (None, False, None, False)
            # A whole-number bound takes the place of a list of values.
            values = None if allowed is None or whole else allowed.split("|")
            rows.append((version, operation, argument, values, decimal or whole, low, excluded, high, whole))
    text = "catalogue_version string, operation string, argument string, allowed array<string>, is_decimal boolean, low int, low_excluded boolean, high int, is_whole boolean"
    return spark.createDataFrame(rows, text).withColumn("low", F.col("low").cast("decimal(38,18)")).withColumn("high", F.col("high").cast("decimal(38,18)"))


def parse(plans: DataFrame, column: str = "plan_json") -> DataFrame:
    return plans.withColumn("_plan", F.from_json(column, PLAN))


def flatten(plans: DataFrame, column: str = "plan_json") -> DataFrame:
    """partitions -> flows -> steps as rows. A plan of version 1 has one list of steps, which each of its flows runs.

    Plans that cannot be read, or have no steps, give one row with nothing but their id, so that no plan is lost.
    """
    plan = parse(plans, column).select("plan_id", F.col("_plan.elementCatalogVersion").alias("catalogue_version"), F.col("_plan.steps").alias("shared"), F.col("_plan.executionSnapshot.partitions").alias("ps"))
    flows = plan.select("plan_id", "catalogue_version", "shared", F.posexplode_outer("ps").alias("partition_no", "p")).select(
        "plan_id", "catalogue_version", "shared", "partition_no", F.col("p.key").alias("partition_key"), F.col("p.budgetCapBps").alias("budget_cap_bps"), F.posexplode_outer("p.flows").alias("flow_no", "f")
    )
    steps = flows.select(
        "plan_id", "catalogue_version", "partition_no", "partition_key", "budget_cap_bps", "flow_no", F.col("f.key").alias("flow_id"), F.col("f.officialInstrumentIds").alias("instruments"),
        F.posexplode_outer(F.coalesce("f.steps", "shared")).alias("step_no", "st"),
    )
    return steps.select(
        "plan_id", "catalogue_version", "partition_no", "partition_key", "budget_cap_bps", "flow_no", "flow_id", "instruments", "step_no",
        F.col("st.sequence").alias("sequence"), F.col("st.operation").alias("operation"), F.col("st.arguments").alias("arguments"),
    )


def lint(steps: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Findings per step: UNKNOWN_OPERATION, MISSING_ARGUMENT, UNKNOWN_ARGUMENT, NOT_ALLOWED, NOT_A_NUMBER, OUT_OF_BOUNDS; per flow
    UNSUPPORTED_CATALOGUE, NO_STEPS, NON_CONTIGUOUS and TERMINAL_COUNT.

    Operations are looked up in the version of the catalogue that the plan names, and in no other. The catalogue is the fixed
    table above, so it is broadcast. Flow checks are aggregates over (plan, flow).
    """
    ids = ["plan_id", "flow_id", "sequence", "operation"]
    entries = F.collect_list(F.struct("argument", "allowed", "is_decimal", "low", "low_excluded", "high", "is_whole"))
    known = F.broadcast(catalogue.groupBy("catalogue_version", "operation").agg(entries.alias("_spec")))
    versions = F.broadcast(catalogue.select("catalogue_version", F.lit(True).alias("_supported")).distinct())
    # Both kinds of findings read the steps; stored, the documents are parsed once.
    marked = cut_lineage(steps).join(versions, "catalogue_version", "left")
    joined = marked.filter(F.col("_supported") & F.col("operation").isNotNull()).join(known, ["catalogue_version", "operation"], "left")

    def problem(s: Column) -> Column:
        value = F.try_element_at("arguments", s["argument"])
        number = value.try_cast("decimal(38,18)")
        bad_number = s["is_decimal"] & (number.isNull() | (s["is_whole"] & (number != F.floor(number))))
        code = (
            F.when(value.isNull(), "MISSING_ARGUMENT")
            .when(s["allowed"].isNotNull() & ~F.array_contains(s["allowed"], value), "NOT_ALLOWED")
            .when(bad_number, "NOT_A_NUMBER")
            .when((number < s["low"]) | (s["low_excluded"] & (number == s["low"])) | (number > s["high"]), "OUT_OF_BOUNDS")
        )
        return F.struct(s["argument"].alias("argument"), code.alias("finding"))

    declared = F.filter(F.transform("_spec", problem), lambda x: x["finding"].isNotNull())
    unknown = F.transform(
        F.array_except(F.map_keys("arguments"), F.transform("_spec", lambda s: s["argument"])), lambda k: F.struct(k.alias("argument"), F.lit("UNKNOWN_ARGUMENT").alias("finding"))
    )
    missing_spec = F.array(F.struct(F.lit(None).cast("string").alias("argument"), F.lit("UNKNOWN_OPERATION").alias("finding")))
    found = F.when(F.col("_spec").isNull(), missing_spec).otherwise(F.concat(declared, unknown))
    per_step = joined.select(*ids, F.explode(found).alias("_f")).select(*ids, "_f.argument", "_f.finding")
    flow = marked.groupBy("plan_id", "flow_id").agg(
        F.min("sequence").alias("_lo"), F.max("sequence").alias("_hi"), F.count("operation").alias("_n"), F.count_distinct("sequence").alias("_d"),
        F.count_if(F.col("operation") == TERMINAL).alias("_t"), F.max_by("operation", "sequence").alias("_last"), F.max("_supported").alias("_supported"),
    )
    gap = (F.col("_lo") != 1) | (F.col("_hi") != F.col("_n")) | (F.col("_d") != F.col("_n"))
    some = F.col("_n") > 0
    codes = F.filter(
        F.array(
            F.when(F.col("_supported").isNull(), "UNSUPPORTED_CATALOGUE"),
            F.when(~some, "NO_STEPS"),
            F.when(some & gap, "NON_CONTIGUOUS"),
            F.when(some & ((F.col("_t") != 1) | (F.col("_last") != TERMINAL)), "TERMINAL_COUNT"),
        ),
        lambda x: x.isNotNull(),
    )
    per_flow = flow.select("plan_id", "flow_id", F.explode(codes).alias("finding")).select(
        "plan_id", "flow_id", F.lit(None).cast("int").alias("sequence"), F.lit(None).cast("string").alias("operation"), F.lit(None).cast("string").alias("argument"), "finding"
    )
    return per_step.unionByName(per_flow)


def _line(**fields: Column) -> Column:
    """name=value, further fields behind bars."""
    parts = [F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items()]
    return F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit("|"), p) if i else (p,))])


def plan_checksum(plans: DataFrame, column: str = "plan_json") -> DataFrame:
    """``sha256:`` digest over the ordered text lines of a plan, computed inside its own document (no shuffle)."""
    plan, snapshot = F.col("_plan"), F.col("_plan.executionSnapshot")
    none = F.array().cast("array<string>")

    def step_line(st: Column) -> Column:
        entries = F.transform(F.array_sort(F.map_keys(st["arguments"])), lambda k: F.concat(F.lit("|"), k, F.lit("="), F.element_at(st["arguments"], k)))
        return F.concat(F.lit("step="), st["sequence"].cast("string"), F.lit("|"), st["operation"], F.array_join(entries, ""))

    def steps(listed: Column) -> Column:
        return F.coalesce(F.transform(listed.cast(f"array<{STEP.simpleString()}>"), step_line), none)

    def flow_lines(f: Column) -> Column:
        return F.concat(F.array(_line(flow=f["key"], officialInstrumentIds=F.array_join(f["officialInstrumentIds"], ","))), steps(f["steps"]))

    def partition_lines(p: Column) -> Column:
        return F.concat(F.array(_line(partition=p["key"], budgetCapBps=p["budgetCapBps"])), F.flatten(F.transform(p["flows"], flow_lines)))

    def feature_line(f: Column) -> Column:
        rest = _line(
            requirementId=f["requirementId"], featureId=f["featureId"], featureVersion=f["featureVersion"], instruments=F.array_join(F.array_sort(f["instruments"]), ","),
            resolution=f["resolution"], requiredObservations=f["requiredObservations"],
        )
        return F.concat(F.lit("requiredFeature="), rest)

    version = snapshot["immutableStrategyVersion"]
    # Names and order of the lines.
    head = [
        ("contractVersion", plan), ("schemaVersion", plan), ("snapshotSchemaVersion", version), ("semanticHash", version), ("snapshotHash", version), ("elementCatalogVersion", plan),
        ("instrumentCatalogVersion", plan), ("compilerVersion", plan), ("requiredFeatureSetHash", plan), ("mode", snapshot), ("initialCashAmount", snapshot), ("currency", snapshot),
    ]
    lines = F.concat(
        F.array(*[_line(**{name: holder[name]}) for name, holder in head]),
        F.coalesce(F.transform(plan["requiredFeatures"], feature_line), none),
        F.flatten(F.transform(snapshot["partitions"], partition_lines)),
        steps(plan["steps"]),
    )
    digest = F.concat(F.lit("sha256:"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256))
    # A missing field makes the digest NULL: such a plan has no checksum.
    return parse(plans, column).select("plan_id", F.when(F.forall(lines, lambda x: x.isNotNull()), digest).alias("checksum"), plan["planChecksum"].alias("stated"))
