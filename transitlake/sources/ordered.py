"""Ordered results in many files (S6, O2) and their pages.

A sorted frame is written with its partitions in order, so the file names sort as the rows do. Beside the folder lies an index,
``<folder>.index``: each file's name, number of rows and first place. ``read_ordered`` gives every row its place again; a page reads only
the files that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.sources.files import exists, read_csv, write_csv

ROWS_PER_FILE = 1_000_000


def _index_of(rows: DataFrame) -> DataFrame:
    """(file, n, first) of a CSV folder's rows: one row a file, so the window is as small as the list of files."""
    counted = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def write_ordered(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the sorted frame ``df`` as header CSV files of at most ``rows_per_file`` rows, and their index."""
    path, spark = path.rstrip("/"), df.sparkSession
    write_csv(df, path, rows_per_file=rows_per_file)
    _index_of(read_csv(spark, path, df.schema)).coalesce(1).write.mode("overwrite").parquet(f"{path}.index")


def index(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The index of a result: as stored, or counted now where there is none."""
    path = path.rstrip("/")
    if exists(spark, f"{path}.index"):
        return spark.read.schema("file string, n long, first long").parquet(f"{path}.index")
    return _index_of(read_csv(spark, path, schema))


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``rang``, their place (from 1) in the whole result. A window holds one file."""
    names = rows.columns
    seen = rows.select(*names, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row"))
    own = F.row_number().over(Window.partitionBy("file").orderBy("_block", "_row"))
    return (seen.withColumn("_own", own).join(files.select("file", "first"), "file")
            .select(*names, (F.col("first") + F.col("_own")).alias("rang")))


def read_ordered(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a result with ``rang``; the frame itself has no order until it is sorted by that."""
    if not exists(spark, path):
        return read_csv(spark, path, schema).withColumn("rang", F.lit(0).cast("long"))
    return _placed(read_csv(spark, path, schema), index(spark, path, schema))


def page(spark: SparkSession, path: str, number: int, size: int, schema: T.StructType | None = None) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, in order, with ``rang``. Only the files that hold it are opened."""
    path, low = path.rstrip("/"), number * size
    if not exists(spark, path):
        return read_csv(spark, path, schema).withColumn("rang", F.lit(0).cast("long"))
    files = index(spark, path, schema)
    held = files.where((F.col("first") < low + size) & (F.col("first") + F.col("n") > low)).collect()  # a page spans few files
    if not held:
        return read_csv(spark, path, schema).limit(0).withColumn("rang", F.lit(0).cast("long"))
    rows = read_csv(spark, [f"{path}/{r['file']}" for r in held], schema)
    placed = _placed(rows, spark.createDataFrame([(r["file"], r["first"]) for r in held], "file string, first long"))
    return placed.where((F.col("rang") > low) & (F.col("rang") <= low + size)).orderBy("rang")


def count_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> int:
    return int(index(spark, path, schema).agg(F.sum("n")).first()[0] or 0) if exists(spark, path) else 0
