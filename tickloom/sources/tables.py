"""The driver's parquet tables, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.schemas import TABLES
from tickloom.session import utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = utc(spark).read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")
