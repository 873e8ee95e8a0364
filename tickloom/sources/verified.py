"""Verified scans: what a manifest declares is held against the footers of the objects before any row is read.

Footers are read by tasks, one small read per object and no data page (but where a footer has no statistics of the time column, as with
96-bit timestamps: then that one column is read, a row group at a time). Hooks see the declared objects before a scan and the counts of
the scan itself as it runs, so that neither costs a second pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom.session import utc

FOOTER = "path string, row_count long, byte_size long, columns string, schema_version string, period_start timestamp, period_end timestamp, unreadable string"

#: Findings in the order in which they count.
FINDINGS = ("MISSING", "UNREADABLE", "SCHEMA", "VERSION", "ROW_COUNT", "PERIOD")


def footer_of(path: str, time_column: str) -> tuple:
    """Rows, size, columns, declared version and first and last time of a Parquet object, from its footer."""
    import pyarrow.compute as pc
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def utc_naive(value: object) -> pd.Timestamp:
        stamp = pd.Timestamp(value)
        return stamp.tz_convert("UTC").tz_localize(None) if stamp.tzinfo else stamp

    with system.open_input_file(inside) as source:
        size = source.size()
        file = pq.ParquetFile(source)
        meta = file.metadata
        schema = meta.schema.to_arrow_schema()
        at = [i for i in range(meta.num_columns) if meta.schema.column(i).path == time_column]
        bounds: list[pd.Timestamp] = []
        for group in range(meta.num_row_groups) if at else ():
            known = meta.row_group(group).column(at[0]).statistics
            if known is not None and known.has_min_max:
                bounds += [utc_naive(known.min), utc_naive(known.max)]
                continue
            found = pc.min_max(file.read_row_group(group, columns=[time_column]).column(0)).as_py()
            bounds += [utc_naive(v) for v in found.values() if v is not None]
    columns = ",".join(f"{f.name}:{f.type}" for f in schema)
    version = (meta.metadata or {}).get(b"schema_version", b"").decode() or None
    return meta.num_rows, size, columns, version, min(bounds, default=None), max(bounds, default=None)


def footers(paths: DataFrame, time_column: str) -> DataFrame:
    """One row per object of ``paths`` (column ``path``); objects that cannot be read come with the reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOOTER.split(", ")]
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    rows.append((path, *footer_of(path, time_column), None))
                except Exception as failure:  # noqa: BLE001  any failure to read is a finding, not an end
                    rows.append((path, None, None, None, None, None, None, type(failure).__name__))
            out = pd.DataFrame(rows, columns=names)
            for c in ("row_count", "byte_size"):
                out[c] = out[c].astype("Int64")
            for c in ("period_start", "period_end"):
                out[c] = pd.to_datetime(out[c])
            yield out

    return paths.select("path").mapInPandas(run, FOOTER)


def verify_objects(objects: DataFrame, found: DataFrame, columns: str | None = None, version: str | None = None) -> DataFrame:
    """``objects`` with ``finding``: the first thing in which an object differs from what is declared of it, NULL where nothing does.

    ``objects``: path, row_count, period_start, period_end (the end is exclusive); ``found``: ``footers``. An object of no rows has no
    period to check.
    """
    right = found.select("path", *[F.col(c).alias(f"_f_{c}") for c in ("row_count", "columns", "schema_version", "period_start", "period_end", "unreadable")])
    outside = (F.col("_f_period_start") < F.col("period_start")) | (F.col("_f_period_end") >= F.col("period_end"))
    finding = F.when(F.col("_f_unreadable") == "FileNotFoundError", "MISSING").when(F.col("_f_unreadable").isNotNull() | F.col("_f_row_count").isNull(), "UNREADABLE")
    if columns is not None:
        finding = finding.when(~F.col("_f_columns").eqNullSafe(F.lit(columns)), "SCHEMA")
    if version is not None:
        finding = finding.when(~F.col("_f_schema_version").eqNullSafe(F.lit(version)), "VERSION")
    finding = finding.when(F.col("_f_row_count") != F.col("row_count"), "ROW_COUNT").when(outside, "PERIOD")
    return objects.join(right, "path", "left").select(*objects.columns, finding.alias("finding"))


class ScanRefused(RuntimeError):
    """A validator refused the declared objects; nothing was read."""


def scan_verified(spark: SparkSession, verified: DataFrame, schema: object, validators: Sequence[Callable[[DataFrame], str | None]] = ()) -> DataFrame:
    """Rows of the objects without a finding.

    Every validator sees the verified objects first and refuses the scan by naming a reason. The list of good objects passes the
    driver, as the paths of every scan do: one string per object.
    """
    for validator in validators:
        reason = validator(verified)
        if reason:
            raise ScanRefused(reason)
    paths = [r["path"] for r in verified.filter("finding IS NULL").select("path").collect()]
    if not paths:
        return utc(spark).createDataFrame([], schema)
    return utc(spark).read.schema(schema).parquet(*paths)


def observed(df: DataFrame, step: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observer of one of its steps: the counts are gathered by the job that computes the rows, whichever that is."""
    watch = Observation(step)
    return df.observe(watch, *[value.alias(name) for name, value in counts.items()]), watch
