"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (its
# broadcast decision is the size check for every dimension join), coalesces
# small shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call site per column expression: frames build faster
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "transitlake", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one.

    What was submitted (master, ``--conf``, spark-defaults.conf) stands: the defaults above are set
    only where a key is unset, and ``master`` only where none was submitted (Spark's own fallback
    is ``local[*]``). ``extra`` and ``shuffle_partitions`` are the caller's explicit settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    SparkContext._ensure_initialized()  # the submitted settings become visible to SparkConf
    submitted = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master and submitted.get("spark.master", "local[*]") == "local[*]":
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        if not submitted.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only a single-JVM session without one (tests, local mode) gets a
    fresh folder under the system temp dir; any cluster session without one is an
    error, because executor-local folders do not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    d = tempfile.mkdtemp(prefix="transitlake-ckpt-")
    sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that ``stored`` makes inside the block, for the caller to ``drop`` when no frame reads them any more."""
    token = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new scratch folder and read from there: it is computed once, its lineage ends, and it
    survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
