"""Readers for manifests, bars and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import BARS, FEATURES, MANIFEST
from tickloom.session import utc


def shard_of(instrument: Column, shards: int | Column) -> Column:
    """Shard number: first eight bytes of SHA-256 as an unsigned big-endian integer, modulo the shard count."""
    high = F.conv(F.substring(F.sha2(instrument.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    count = F.lit(shards) if isinstance(shards, int) else shards
    return (high % count.cast("decimal(10,0)")).cast("int")


def shard_label(shard: Column, shards: Column) -> Column:
    return F.concat(F.lit("s"), F.lpad(shard.cast("string"), 2, "0"), F.lit("-of-"), shards.cast("string"))


def prune_shards(objects: DataFrame, instruments: DataFrame) -> DataFrame:
    """Objects that may hold a wanted instrument. Labels that are not understood are never pruned.

    The shard counts in use (one or two layouts of a dataset) enter as a scalar subquery.
    """
    pattern = r"^s(\d+)-of-(\d+)$"
    parsed = objects.withColumn("_shard", F.nullif(F.regexp_extract("shard_key", pattern, 1), F.lit("")).cast("int")).withColumn(
        "_of", F.nullif(F.regexp_extract("shard_key", pattern, 2), F.lit("")).cast("int")
    )
    counts = parsed.filter(F.col("_of") > 0).select(F.collect_set("_of")).scalar()
    wanted = instruments.select("instrument_id", F.explode(counts).alias("_of")).select(shard_of(F.col("instrument_id"), F.col("_of")).alias("_shard"), "_of").distinct()
    known = parsed.filter(F.col("_of") > 0).join(wanted, ["_shard", "_of"], "left_semi").select(*objects.columns)
    return known.unionByName(parsed.filter(F.col("_of").isNull() | (F.col("_of") <= 0)).select(*objects.columns))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return utc(spark).read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_objects(manifests: DataFrame) -> DataFrame:
    """One row per object of each manifest."""
    head = [c for c in manifests.columns if c != "objects"]
    return manifests.select(*[F.col(c).alias(f"manifest_{c}" if c in ("period_start", "period_end", "schema_version") else c) for c in head], F.explode("objects").alias("o")).select(
        *[f"manifest_{c}" if c in ("period_start", "period_end", "schema_version") else c for c in head], "o.*"
    )


def scan_bars(spark: SparkSession, paths: Sequence[str], instruments: Sequence[str], start: str, end: str) -> DataFrame:
    """Bars of the wanted instruments in ``[start, end)``; both predicates reach the parquet row groups."""
    return (
        utc(spark)
        .read.schema(BARS)
        .parquet(*paths)
        .filter(F.col("instrument_id").isin(list(instruments)))
        .filter((F.col("bar_start_at") >= F.lit(start).cast("timestamp")) & (F.col("bar_start_at") < F.lit(end).cast("timestamp")))
    )


def scan_features(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return utc(spark).read.schema(FEATURES).parquet(*paths)


def scan_partitioned(spark: SparkSession, base: str) -> DataFrame:
    """Hive layout ``provider=/feed=/adjustment=/session=/resolution=/revision=/year=/shard=``; partitions are pruned."""
    return utc(spark).read.option("basePath", base).parquet(base)


def file_digests(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """SHA-256 of every object's bytes. Files are read by tasks; object size bounds the memory of one row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"))


def digest_mismatches(digests: DataFrame, objects: DataFrame) -> DataFrame:
    """Declared objects (path, content_hash) that are absent or whose bytes hash differently."""
    actual = digests.select("path", F.col("content_hash").alias("actual_hash"))
    return objects.join(actual, "path", "left").filter(~F.col("actual_hash").eqNullSafe(F.col("content_hash")))
