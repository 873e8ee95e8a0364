"""Shared text rules and session settings of the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, ensure_checkpoint_dir, utc

# What separates words, what a word is.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes that one Arrow batch may hold: long documents must not add up to a large batch.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def prepare(spark: SparkSession) -> SparkSession:
    """UTC, this package's code on the executors, and small Arrow batches for operators that hand texts to Python."""
    utc(spark)
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """A table in the shared checkpoint folder; see ``tickloom.session.cut_lineage``."""
    return cut_lineage(df)


#: Shuffle files of a job go when it ends; stored tables are packed well; their folders are written side by side, without a sort.
_PACKED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.maxConcurrentOutputFileWriters": "16"}


def store_packed(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Like ``store``, for operators whose tables and shuffles are large beside their input: the shuffle files of the job that writes the
    table go when it ends, so that a chain of stored tables does not hold all of them at once. The settings are those of this job."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in _PACKED}
    for name, value in _PACKED.items():
        conf.set(name, value)
    try:
        return cut_lineage(df, by)
    finally:
        for name, value in before.items():
            conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def without(text: Column, characters: str) -> Column:
    """The text with all of the given characters taken out."""
    return F.translate(text, characters, "")
