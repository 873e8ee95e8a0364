"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETAIL_PARTITIONS = ["run_id", "record_type", "week_start", "part"]


def write_detail(rows: DataFrame, path: str, order: tuple[str, ...] = ("occurred_at", "record_id")) -> None:
    """One uncompressed, sorted parquet file per (run, record type, week, part).

    Rows are shuffled by the part keys, so each part (at most 100 000 rows) is written by one task and a hot run is spread
    over its weeks and parts. Parts that are written again are replaced, so a retried write leaves no row twice.
    """
    (
        rows.repartition(*[F.col(c) for c in DETAIL_PARTITIONS])
        .sortWithinPartitions(*DETAIL_PARTITIONS, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "uncompressed")
        .partitionBy(*DETAIL_PARTITIONS)
        .parquet(path)
    )


def write_results_json(records: DataFrame, path: str, keys: tuple[str, ...] = ("run_id",)) -> None:
    """Canonical sorted-key JSON lines of each run's records; decimals as text."""
    typed = [F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in sorted(records.dtypes)]
    line = F.to_json(F.struct(*typed), {"ignoreNullFields": "false"})
    records.select(*keys, line.alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_summaries(tables: dict[str, DataFrame], base: str) -> None:
    """Replace the partitions of the given runs in each summary table; other runs stay."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{base}/{name}")
