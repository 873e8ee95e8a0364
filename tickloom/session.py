"""Session helpers: time zone, checkpoint folder, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "tickloom") -> SparkSession:
    """A session with the settings every operator relies on (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone; all timestamps are UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A temporary one is used in local mode only, where driver and executors
    are one process; a cluster without the setting is refused."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_stored: dict[str, SparkSession] = {}


@atexit.register
def _remove_stored() -> None:
    """Delete the stored tables of this driver when it ends, as far as its sessions still run."""
    for folder, spark in _stored.items():
        with contextlib.suppress(Exception):
            context = spark.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and continue from the stored table.

    ``by`` names columns of few values that become folders of the table, so that a reader of one value opens its files only.

    Used between dependent scans, which would otherwise recompute everything below them once per branch. A stored
    columnar table survives the loss of executors and lets each branch read only its own columns.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/tables"
    _stored[root] = spark
    folder = f"{root}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    stored = spark.read.schema(df.schema).parquet(folder)
    stored._stored_in = folder
    return stored


def drop_stored(df: DataFrame) -> None:
    """Delete the folder of a table that ``cut_lineage`` gave, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._stored_in)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
