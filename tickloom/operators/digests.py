"""Content digests: object metadata hashes, canonical rows, and digests of whole runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import canonical_json

# Object metadata covered by a dataset hash.
DATASET_HASH_FIELDS = (
    "content_hash",
    "object_kind",
    "partition_granularity",
    "partition_start",
    "partition_end",
    "period_start",
    "period_end",
    "shard_key",
    "part_number",
    "row_count",
    "schema_version",
)


def dataset_hash(objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SHA-256 of the sorted canonical JSON of a manifest's objects.

    One manifest lists its files (shards x periods), so the collected list is bounded by the manifest itself.
    """
    text = canonical_json({f: f for f in DATASET_HASH_FIELDS})
    rows = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("]"))
    return objects.groupBy(*keys).agg(F.sha2(rows.cast("binary"), 256).alias("dataset_hash"))


def loader_dataset_hash(objects: DataFrame, keys: Sequence[str], header: Mapping[str, Column]) -> DataFrame:
    """Publication digest: a header plus the ordered (shard, part, content hash) triples of the manifest's objects."""
    entry = canonical_json({"shard_key": "shard_key", "part_number": "part_number", "content_hash": "content_hash"})
    listed = objects.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard_key", "part_number", entry.alias("e")))), lambda x: x["e"]).alias("_o")
    )
    fields = {**{k: F.to_json(F.struct(v.alias("v"))) for k, v in header.items()}}
    lines = [F.concat(F.lit(f"{k}="), fields[k]) for k in sorted(fields)]
    text = F.concat_ws("\n", *lines, F.array_join("_o", ","))
    return listed.select(*keys, F.sha2(text.cast("binary"), 256).alias("dataset_hash"))


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of one row's fields, each behind its length, so that different rows never have one text form."""
    return F.sha2(joined_fields(columns).cast("binary"), 256)


def joined_fields(columns: Sequence[str]) -> Column:
    """Fields in order as length:text, a missing value as a bare minus sign."""

    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[field(c) for c in columns])


def run_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: Sequence[int] = (6, 3)) -> DataFrame:
    """Order-independent digest of all rows of a key, as a hash tree.

    Equal rows are counted first, then hashes are grouped by their leading hex digits and every group is hashed in sorted
    order. A group holds a few thousand entries even for billions of rows, so no task ever collects a whole run.
    """
    counted = df.select(*keys, row_hash(columns).alias("_h")).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n"))
    level = counted.select(*keys, F.col("_h").alias("_p"), F.concat(F.col("_h"), F.lit(":"), F.col("_n").cast("string")).alias("_t"))
    for digits in (*levels, 0):
        grouped = level.withColumn("_p", F.substring("_p", 1, digits)) if digits else level.withColumn("_p", F.lit(""))
        joined = F.array_join(F.array_sort(F.collect_list("_t")), ",")
        level = grouped.groupBy(*keys, "_p").agg(F.sha2(joined.cast("binary"), 256).alias("_t"))
        level = level.withColumn("_t", F.concat_ws("=", F.col("_p"), F.col("_t"))) if digits else level
    return level.select(*keys, F.col("_t").alias("digest"))


def diff_runs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose digests differ or exist on one side only."""
    left, right = a.withColumnRenamed("digest", "digest_a"), b.withColumnRenamed("digest", "digest_b")
    return left.join(right, list(keys), "full").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
