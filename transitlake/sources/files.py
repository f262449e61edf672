"""File sources and sinks: result CSVs, document collections, JSON maps.

Writers are partitioned Spark writes (no driver-side collection). Results with
a row per line or class are coalesced to one file; results that grow with the data
and collections keep their partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import schema as S
from transitlake.functions.calc import nan_to_null
from transitlake.operators.positional import with_position
from transitlake.sources.jsonsplit import json_records


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Header CSV with a declared schema (type inference only when none
    is given); a missing path yields an empty frame with that schema."""
    if isinstance(path, str) and not exists(spark, path):
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_report(spark: SparkSession, path: str, report: str) -> DataFrame:
    """S4 for a report file, typed by its contract."""
    return read_csv(spark, path, S.contract_schema(report))


def project_contract(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    """Reorder to the contract, add missing columns as NULL, drop extras,
    and turn NaN into NULL (written as an empty field)."""
    have = set(df.columns)
    out = []
    for name, dtype in columns:
        c = F.col(name).cast(dtype) if name in have else F.lit(None).cast(dtype)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        out.append(c.alias(name))
    return df.select(out)


def write_csv(df: DataFrame, path: str, single_file: bool = False, rows_per_file: int = 0) -> None:
    """Header CSV, UTF-8, overwrite; an empty frame still gets its header. ``single_file`` is for results
    whose size does not grow with the data; otherwise every part file carries the header."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("maxRecordsPerFile", rows_per_file).csv(path))


# Reports with a row per line, class or top-k entry; the others (a row per day, vehicle, driver or measure) grow.
SMALL_REPORTS = frozenset("aceghijlnf")


def write_report(df: DataFrame, path: str, report: str) -> None:
    """S6 + S7 for a report."""
    write_csv(project_contract(df, S.REPORT_COLUMNS[report]), path, single_file=report in SMALL_REPORTS)


def write_collection(df: DataFrame, path: str, max_records_per_file: int = 5_000_000,
                     partition_by: list[str] | None = None) -> None:
    """Replace a collection (overwrite), with a cap on the rows of a file."""
    w = df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """One JSON record per line (the column already holds JSON text)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json_map(entries: DataFrame, path: str, key: str) -> None:
    """One JSON object, ``{"<key>": {other columns}, ...}``, as one file in key order. For maps of a dimension's size;
    ``read_json_map`` reads it in as many tasks as it has splits."""
    others = [c for c in entries.columns if c != key]
    pair = F.concat(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), F.lit(""))
    name = F.regexp_extract(pair, r'(?s)^\{"k":(.*)\}$', 1)  # the key as a JSON string
    ordered = with_position(entries.where(F.col(key).isNotNull()), [], [key, *others], name="_at")
    comma = F.when(F.col("_at") > 0, ",").otherwise("")
    lines = ordered.select(F.col("_at"), F.concat(comma, name, F.lit(": "), F.to_json(F.struct(*others), {"ignoreNullFields": "false"})).alias("value"))
    frame = entries.sparkSession.createDataFrame([(-1, "{"), (1 << 62, "}")], "_at long, value string")
    lines.unionByName(frame).coalesce(1).sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def read_json_map(spark: SparkSession, path: str, value: T.StructType, key: str = "key") -> DataFrame:
    """The entries of JSON maps, as ``map<string,struct>`` exploded: (``key``, fields of ``value``). The files hold one
    object of any size or one a line."""
    records = json_records(spark, path)
    parsed = F.from_json(F.concat(F.lit("{"), F.col("json"), F.lit("}")), T.MapType(T.StringType(), value))
    return records.select(F.explode(parsed).alias(key, "v")).select(key, "v.*")


def list_result_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """Result files of a folder, sorted by name (path and size only;
    the content column is never read). ``result`` is the result that a part file belongs to."""
    if not exists(spark, directory):
        return spark.createDataFrame([], "name string, path string, length long, result string")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(directory).select("path", "length"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    result = F.when(name.startswith("part-"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).otherwise(name)
    return files.select(name.alias("name"), "path", "length", result.alias("result")).orderBy("name")


def preview(df: DataFrame, n: int = 5, text_columns: tuple[str, ...] = (), width: int = 200) -> DataFrame:
    """First n rows, long text cut to ``width`` characters."""
    cols = [F.substring(F.col(c), 1, width).alias(c) if c in text_columns else F.col(c) for c in df.columns]
    return df.select(cols).limit(n)
