r"""Reading one large JSON document in many tasks.

A JSON array or object is a single document, which Spark's reader parses in one task. Here the file is read as text cut at ``}``,
which the text source splits by bytes, and the structure is found from running totals over the pieces in file order: the
parity of the quotes tells which pieces begin inside a string, the depth of brackets outside strings tells where a
record ends. A running total is a window inside a chunk (at most ``CHUNK`` pieces of one split of a file) plus the totals of the
chunks before it, so no window holds more than a chunk and a large split is shared by many tasks, whatever the size of the file. The pieces of a record, which may lie in two splits, are then put
together; records are numbered by the ends before them.

Escapes never straddle a cut, since ``\}`` is none. Records are objects; an element of another kind before one fails
the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.session import stored

CHUNK = 1 << 14
_CHUNK = ["file", "block", "chunk"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, chunk, row, value): the text between two ``}``; ``row`` and ``chunk`` rise within a split."""
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("row"), "value")
    return rows.withColumn("chunk", F.floor(F.col("row") / CHUNK))


def _running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier pieces of the same file."""
    local = Window.partitionBy(*_CHUNK).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("_v", value).withColumn("_l", F.coalesce(F.sum("_v").over(local), F.lit(0)))
    chunks = valued.groupBy(*_CHUNK).agg(F.sum("_v").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    return valued.join(chunks.drop("_t"), _CHUNK).withColumn(name, F.col("_l") + F.col("_b")).drop("_v", "_l", "_b")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def json_records(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(file, at, json): the objects of the array ``member`` of each file's root object, or, without ``member``, the object
    members (``"key": {...}``) or elements of the root itself. ``at`` counts them from 0 in each file."""
    clean = F.regexp_replace("value", r"\\.", "")
    pieces = stored(_pieces(spark, path).withColumn("clean", clean), "json-pieces")
    quoted = _running(pieces, _count(F.col("clean"), '"'), "quotes")

    inside = F.col("quotes") % 2 == 1
    aligned = F.when(inside, F.concat(F.lit('"'), F.col("clean"))).otherwise(F.col("clean"))
    opener = rf'"{member}"\s*:\s*\['
    marked = F.regexp_replace(aligned, opener, "@") if member else aligned
    shape = F.regexp_replace(F.regexp_replace(marked, r'"[^"]*("|$)', ""), r"[^\[\]{}@]", "")
    ends_outside = (F.col("quotes") + _count(F.col("clean"), '"')) % 2 == 0
    shaped = quoted.withColumn("shape", shape).withColumn("closes", ends_outside.cast("int"))
    deep = stored(_running(shaped, _count(F.col("shape"), "{[@") - _count(F.col("shape"), "]") - F.col("closes"), "depth").drop("clean"), "json-depths")

    at = F.struct("block", "row")
    after = F.col("depth") + _count(F.col("shape"), "{[@") - _count(F.col("shape"), "]") - F.col("closes")
    if member:
        lead = F.substring_index("shape", "@", 1)
        opens = F.col("shape").contains("@") & (F.col("depth") + _count(lead, "{[") - _count(lead, "]") == 1)
        shut = F.when(opens, F.regexp_replace("shape", "^[^@]*@", "")).when(F.col("depth") == 2, F.col("shape")).startswith("]")
        deep = deep.withColumn("opens", opens).withColumn("shuts", F.coalesce(shut, F.lit(False))).withColumn("after", after)
        first = deep.where("opens").groupBy("file").agg(F.min(at).alias("first"))
        last = (deep.where("shuts").join(first, "file").where(at >= F.col("first")).groupBy("file").agg(F.min(at).alias("last")))
        held = deep.join(first, "file").join(last, "file", "left").where((at >= F.col("first")) & (F.col("last").isNull() | (at < F.col("last"))))
        level, head = 2, rf"(?s)^.*?{opener}"
    else:
        held = deep.withColumn("opens", (F.col("depth") == 0) & F.col("shape").rlike(r"^[\[{]")).withColumn("after", after)
        level, head = 1, r"(?s)^\s*[\[{]"
    ended = held.withColumn("end", ((F.col("after") == level) & (F.col("closes") == 1)).cast("int"))
    numbered = _running(ended, F.col("end"), "at")
    own = F.when(F.col("opens"), F.regexp_replace("value", head, "")).otherwise(F.col("value"))
    records = (numbered.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("block", "row", own.alias("t")))).alias("parts"), F.max("end").alias("end"))
               .where("end = 1"))
    text = F.concat(F.concat_ws("}", F.transform("parts", lambda p: p["t"])), F.lit("}"))
    record = records.select("file", "at", F.regexp_replace(text, r"^[\s,]+", "").alias("json"))
    fine = F.substring("json", 1, 1).isin(*(["{"] if member else ["{", '"']))
    return record.withColumn("json", F.when(fine, F.col("json")).otherwise(F.raise_error(F.lit("json_records: an element that is no object"))))


def numbered_over_files(records: DataFrame, name: str = "idx") -> DataFrame:
    """``json_records`` with ``name``: the place over all files in file order."""
    files = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return records.join(offsets, "file").withColumn(name, F.col("_first") + F.col("at")).drop("_first")
