"""Explicit schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 8)
MONEY = T.DecimalType(24, 8)
FEATURE_VALUE = T.DecimalType(38, 8)


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


BARS = _s(
    ("instrument_id", T.StringType(), False),
    ("provider_symbol", T.StringType(), False),
    ("bar_start_at", T.TimestampType(), False),
    ("session_date_et", T.DateType(), False),
    ("open", T.DoubleType(), False),
    ("high", T.DoubleType(), False),
    ("low", T.DoubleType(), False),
    ("close", T.DoubleType(), False),
    ("volume", T.LongType(), False),
)

FEATURES = _s(("bar_start_at", T.TimestampType(), False), ("value", FEATURE_VALUE, False))

MANIFEST = _s(
    ("contract_id", T.StringType()),
    ("schema_version", T.StringType()),
    ("manifest_id", T.StringType()),
    ("dataset_id", T.StringType()),
    ("revision", T.StringType()),
    ("status", T.StringType()),
    ("dataset_hash", T.StringType()),
    ("schema_id", T.StringType()),
    ("period_start", T.TimestampType()),
    ("period_end", T.TimestampType()),
    ("available_at", T.TimestampType()),
    (
        "objects",
        T.ArrayType(
            _s(
                ("storage_object_id", T.StringType()),
                ("object_key", T.StringType()),
                ("content_hash", T.StringType()),
                ("object_kind", T.StringType()),
                ("partition_granularity", T.StringType()),
                ("partition_start", T.TimestampType()),
                ("partition_end", T.TimestampType()),
                ("period_start", T.TimestampType()),
                ("period_end", T.TimestampType()),
                ("shard_key", T.StringType()),
                ("part_number", T.IntegerType()),
                ("row_count", T.LongType()),
                ("schema_version", T.StringType()),
            )
        ),
    ),
)

STEP = _s(
    ("sequence", T.IntegerType()),
    ("operation", T.StringType()),
    ("arguments", T.MapType(T.StringType(), T.StringType())),
)

FLOW = _s(
    ("key", T.StringType()),
    ("officialInstrumentIds", T.ArrayType(T.StringType())),
    ("steps", T.ArrayType(STEP)),
)

REQUIRED_FEATURE = _s(
    ("requirementId", T.StringType()),
    ("featureId", T.StringType()),
    ("featureVersion", T.StringType()),
    ("instruments", T.ArrayType(T.StringType())),
    ("resolution", T.StringType()),
    ("requiredObservations", T.IntegerType()),
)

PARTITION = _s(
    ("key", T.StringType()),
    ("budgetCapBps", T.IntegerType()),
    ("flows", T.ArrayType(FLOW)),
)

# Version 1 keeps one list of steps at the top of the document, version 2 a list per flow.
PLAN = _s(
    ("contractVersion", T.StringType()),
    ("schemaVersion", T.StringType()),
    ("elementCatalogVersion", T.StringType()),
    ("instrumentCatalogVersion", T.StringType()),
    ("compilerVersion", T.StringType()),
    ("requiredFeatureSetHash", T.StringType()),
    ("requiredFeatures", T.ArrayType(REQUIRED_FEATURE)),
    (
        "executionSnapshot",
        _s(
            (
                "immutableStrategyVersion",
                _s(("snapshotSchemaVersion", T.StringType()), ("semanticHash", T.StringType()), ("snapshotHash", T.StringType())),
            ),
            ("mode", T.StringType()),
            ("initialCashAmount", T.StringType()),
            ("currency", T.StringType()),
            ("partitions", T.ArrayType(PARTITION)),
        ),
    ),
    ("steps", T.ArrayType(STEP)),
    ("planChecksum", T.StringType()),
)

# Driver tables.
EVENTS = _s(
    ("event_id", T.LongType()),
    ("ts", T.TimestampType()),
    ("user_id", T.LongType()),
    ("event_type", T.StringType()),
    ("value", T.DoubleType()),
    ("props", T.StringType()),
)

LINEITEM = _s(
    ("l_orderkey", T.LongType()),
    ("l_partkey", T.LongType()),
    ("l_suppkey", T.LongType()),
    ("l_linenumber", T.IntegerType()),
    ("l_quantity", T.DoubleType()),
    ("l_extendedprice", T.DoubleType()),
    ("l_discount", T.DoubleType()),
    ("l_tax", T.DoubleType()),
    ("l_returnflag", T.StringType()),
    ("l_linestatus", T.StringType()),
    ("l_shipdate", T.TimestampType()),
)

ORDERS = _s(
    ("o_orderkey", T.LongType()),
    ("o_custkey", T.LongType()),
    ("o_orderstatus", T.StringType()),
    ("o_totalprice", T.DoubleType()),
    ("o_orderdate", T.TimestampType()),
    ("o_orderpriority", T.StringType()),
)

PART = _s(
    ("p_partkey", T.LongType()),
    ("p_name", T.StringType()),
    ("p_brand", T.StringType()),
    ("p_type", T.StringType()),
    ("p_size", T.IntegerType()),
    ("p_retailprice", T.DoubleType()),
)

CUSTOMER = _s(
    ("c_custkey", T.LongType()),
    ("c_name", T.StringType()),
    ("c_nationkey", T.IntegerType()),
    ("c_acctbal", T.DoubleType()),
    ("c_mktsegment", T.StringType()),
)

SUPPLIER = _s(
    ("s_suppkey", T.LongType()),
    ("s_name", T.StringType()),
    ("s_nationkey", T.IntegerType()),
    ("s_acctbal", T.DoubleType()),
)

NATION = _s(("n_nationkey", T.IntegerType()), ("n_name", T.StringType()), ("n_regionkey", T.IntegerType()))
REGION = _s(("r_regionkey", T.IntegerType()), ("r_name", T.StringType()))

TABLES = {
    "events": EVENTS,
    "lineitem": LINEITEM,
    "orders": ORDERS,
    "part": PART,
    "customer": CUSTOMER,
    "supplier": SUPPLIER,
    "nation": NATION,
    "region": REGION,
}
