"""Detail records per local week, cut into parts, with manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import uuid5
from tickloom.operators.digests import joined_fields
from tickloom.operators.calendar import et_week
from tickloom.operators.scan import with_position
from tickloom.session import cut_lineage

ROWS_PER_PART = 100_000
PART_KEYS = ["run_id", "record_type", "week_start"]


def assign_week(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("week_start", et_week(ts))


def number_parts(df: DataFrame, ts: str, ids: Sequence[str], rows_per_part: int = ROWS_PER_PART, whole: bool = False) -> DataFrame:
    """1-based part number inside (run, record type, week); rows are counted by a scan over hours, not in one task, unless runs are
    bounded (``whole``)."""
    placed = with_position(df, PART_KEYS, [ts, *ids], None if whole else F.date_trunc("hour", F.col(ts)), "_pos")
    return placed.withColumn("part", (F.floor((F.col("_pos") - 1) / rows_per_part) + 1).cast("int")).drop("_pos")


def detail_rows(records: DataFrame, record_type: str, ts: str, ids: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Common shape of the four record types: run, type, instant, identity, payload as text map."""
    identity = joined_fields(ids)
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in payload]), F.array(*[F.col(c).cast("string") for c in payload]))
    return records.select("run_id", F.lit(record_type).alias("record_type"), F.col(ts).alias("occurred_at"), identity.alias("record_id"), pairs.alias("payload"))


def part_manifest(rows: DataFrame, ts: str, identity: str) -> DataFrame:
    """Bounds, row count and identities hash of each part. A part holds at most ``ROWS_PER_PART`` rows by construction."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(identity).alias("i"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["i"]), "\n")
    return rows.groupBy(*PART_KEYS, "part").agg(
        F.min(ts).alias("period_start"), F.max(ts).alias("period_end"), F.count(F.lit(1)).alias("row_count"), F.sha2(joined.cast("binary"), 256).alias("identities_hash")
    )


def equity_points(curve: DataFrame) -> DataFrame:
    """Equity series points with deterministic ids."""
    name = F.concat_ws(":", F.lit("equity"), F.col("run_id").cast("string"), F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return curve.select(uuid5(name).alias("point_id"), "run_id", F.lit("equity").alias("metric"), "as_of", F.col("equity").alias("value"))


def detail_key(prefix: str, content_hash: Column) -> Column:
    return F.concat_ws(
        "/",
        F.lit(prefix),
        F.col("run_id").cast("string"),
        F.col("record_type"),
        F.concat(F.lit("week_start="), F.date_format("week_start", "yyyy-MM-dd")),
        F.concat(F.lit("part="), F.lpad(F.col("part").cast("string"), 4, "0")),
        F.concat(content_hash, F.lit(".parquet")),
    )


def parse_detail_key(key: str) -> dict[str, Column]:
    """Columns of a key; NULL where the key does not have the expected form."""
    pattern = r"^[^/]+/([^/]+)/([^/]+)/week_start=(\d{4}-\d{2}-\d{2})/part=(\d{4})/([^/]+)\.parquet$"

    def piece(i: int) -> Column:
        return F.nullif(F.regexp_extract(key, pattern, i), F.lit(""))

    return {
        "run_id": piece(1),
        "record_type": piece(2),
        "week_start": piece(3).try_cast("date"),
        "part": piece(4).try_cast("int"),
        "content_hash": piece(5),
    }


#: Order of the record types in a bundle.
RECORD_TYPES = ("TRADE", "POSITION", "LEDGER", "CALCULATION")


def _type_rank() -> Column:
    rank = F.lit(len(RECORD_TYPES))
    for i, kind in enumerate(RECORD_TYPES):
        rank = F.when(F.col("record_type") == kind, i).otherwise(rank)
    return rank


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _combined(rows: DataFrame, keys: Sequence[str], order: Column, label: Column, level: str) -> DataFrame:
    """One node per ``keys``: the digest of its children's labels and digests in order. Children are bounded: parts of a week, weeks of
    the calendar, types of a bundle."""
    child = F.struct(order.alias("o"), label.alias("l"), F.col("digest").alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat(x["l"], F.lit(":"), x["d"])), "\n")
    found = rows.groupBy(*keys).agg(_sha(joined).alias("digest"), F.sum("row_count").alias("row_count"))
    blank = {"record_type": F.lit(None).cast("string"), "week_start": F.lit(None).cast("date")}
    return found.select("run_id", *[F.col(c) if c in keys else blank[c].alias(c) for c in blank], F.lit(level).alias("level"), "digest", "row_count")


def bundle_tree(parts: DataFrame) -> DataFrame:
    """``run_id, record_type, week_start, level, digest, row_count``: an order-sensitive hash tree over the parts of each run.

    ``parts`` is ``part_manifest``. A WEEK is the digest of its parts in order, a TYPE of its weeks, a BUNDLE of its types. A change of one
    part changes the three nodes above it and no other.
    """
    leaves = parts.withColumnRenamed("identities_hash", "digest")
    weeks = _combined(leaves, PART_KEYS, F.col("part").cast("long"), F.col("part").cast("string"), "WEEK")
    types = _combined(weeks, ["run_id", "record_type"], F.unix_date("week_start").cast("long"), F.date_format("week_start", "yyyy-MM-dd"), "TYPE")
    bundles = _combined(types, ["run_id"], _type_rank().cast("long"), F.col("record_type"), "BUNDLE")
    return weeks.unionByName(types).unionByName(bundles)


def bundles_of_runs(rows: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """What ``bundle_tree`` gives over the ``part_manifest`` of numbered rows, for bounded runs whose rows are partitioned by ``run_id``.

    ``rows``: ``run_id``, ``week_start`` and for each of ``RECORD_TYPES`` a list of structs ``t, i``, the instants and identities of
    records of that week. Records meet as the lists of a week and weeks as those of a run: none is unfolded, numbered or sent again.
    """
    lists = [F.sort_array(F.flatten(F.collect_list(kind))).alias(kind) for kind in RECORD_TYPES]
    found = rows.groupBy("run_id", "week_start").agg(*lists)
    found = found.select("run_id", "week_start", *[F.transform(kind, lambda x: x["i"]).alias(kind) for kind in RECORD_TYPES])

    def week(kind: str) -> Column:
        count = F.size(kind)

        def part(n: Column) -> Column:
            text = F.array_join(F.slice(F.col(kind), n * rows_per_part + 1, F.lit(rows_per_part)), "\n")
            return F.concat((n + 1).cast("string"), F.lit(":"), _sha(text))

        numbers = F.sequence(F.lit(0), F.floor((count - 1) / rows_per_part).cast("int"))
        node = F.struct(F.unix_date("week_start").alias("o"), "week_start", _sha(F.array_join(F.transform(numbers, part), "\n")).alias("digest"), count.cast("long").alias("row_count"))
        return F.when(count > 0, node)

    weeks = found.select("run_id", *[week(kind).alias(kind) for kind in RECORD_TYPES])
    runs = weeks.groupBy("run_id").agg(*[F.sort_array(F.collect_list(kind)).alias(kind) for kind in RECORD_TYPES])

    def rows_of(nodes: str | Column) -> Column:
        return F.aggregate(nodes, F.lit(0).cast("long"), lambda n, x: n + x["row_count"])

    def kind_node(kind: str) -> Column:
        text = F.array_join(F.transform(kind, lambda x: F.concat(F.date_format(x["week_start"], "yyyy-MM-dd"), F.lit(":"), x["digest"])), "\n")
        return F.when(F.size(kind) > 0, F.struct(F.lit(kind).alias("record_type"), _sha(text).alias("digest"), rows_of(kind).alias("row_count")))

    typed = runs.withColumn("_types", F.array_compact(F.array(*[kind_node(kind) for kind in RECORD_TYPES])))

    def node(level: str, record_type: Column, week_start: Column, digest: Column, row_count: Column) -> Column:
        return F.struct(record_type.alias("record_type"), week_start.alias("week_start"), F.lit(level).alias("level"), digest.alias("digest"), row_count.alias("row_count"))

    def week_nodes(kind: str) -> Column:
        return F.transform(kind, lambda x: node("WEEK", F.lit(kind), x["week_start"], x["digest"], x["row_count"]))

    no_type, no_week = F.lit(None).cast("string"), F.lit(None).cast("date")
    bundle = _sha(F.array_join(F.transform("_types", lambda x: F.concat(x["record_type"], F.lit(":"), x["digest"])), "\n"))
    tree = F.concat(
        *[week_nodes(kind) for kind in RECORD_TYPES],
        F.transform("_types", lambda x: node("TYPE", x["record_type"], no_week, x["digest"], x["row_count"])),
        F.array(node("BUNDLE", no_type, no_week, bundle, rows_of("_types"))),
    )
    return typed.select("run_id", F.inline(tree))


def update_bundle_tree(tree: DataFrame, parts: DataFrame, changed: DataFrame) -> DataFrame:
    """The tree after parts have changed: ``parts`` are all parts as they are now, ``changed`` holds run, type and week of those that
    changed. Only the paths above them are worked out again; everything else is taken from ``tree``."""
    touched = changed.select(*PART_KEYS).distinct()
    leaves = parts.join(touched, PART_KEYS, "left_semi").withColumnRenamed("identities_hash", "digest")
    weeks = _combined(leaves, PART_KEYS, F.col("part").cast("long"), F.col("part").cast("string"), "WEEK")
    old_weeks = tree.filter("level = 'WEEK'").join(touched, PART_KEYS, "left_anti").select(*tree.columns).unionByName(weeks)
    kinds, runs = touched.select("run_id", "record_type").distinct(), touched.select("run_id").distinct()
    again = old_weeks.join(kinds, ["run_id", "record_type"], "left_semi")
    types = _combined(again, ["run_id", "record_type"], F.unix_date("week_start").cast("long"), F.date_format("week_start", "yyyy-MM-dd"), "TYPE")
    all_types = tree.filter("level = 'TYPE'").join(kinds, ["run_id", "record_type"], "left_anti").select(*tree.columns).unionByName(types)
    bundles = _combined(all_types.join(runs, "run_id", "left_semi"), ["run_id"], _type_rank().cast("long"), F.col("record_type"), "BUNDLE")
    same = tree.filter("level = 'BUNDLE'").join(runs, "run_id", "left_anti").select(*tree.columns)
    return old_weeks.unionByName(all_types).unionByName(same.unionByName(bundles))
