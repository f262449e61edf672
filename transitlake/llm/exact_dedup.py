"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only.

Texts are equal when they are the same after lower-casing A-Z. Each input partition makes one run: an entry for each
distinct text of its own, addressed by SHA-256, with its best row and its number of rows. Runs then meet in rounds:
in round r the runs whose numbers agree beyond their last r * log2(``FAN``) bits exchange their entries, by run group
and address, and a sorted merge keeps one entry for each address. After ceil(log(runs) / log(FAN)) rounds one run is
left, spread over all partitions by address. Entries merge only where SHA-256, length in bytes and a second, unrelated
64-bit hash agree, at every level; texts themselves never travel.

A group of copies of any size is one entry a run from the start, and at most ``FAN`` entries meet in a merge. The way back is
the same tree read downwards: the groups of two rows or more go to the entries of each run, and from those to that run's
rows, so that no key holds more rows than an input partition has.

The largest ``doc_id`` of a group stays, a null one only where no other is there; of equal ids the first row that was read.
A null text counts as empty. Repeated rows are rows of their own, one of which can stay. Extra columns are ignored by
``classes`` and kept by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import materialize

FAN = 16
ADDRESS = ("sha", "n_bytes", "check")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def addressed(docs: DataFrame) -> DataFrame:
    """(doc_id, run, row, sha, n_bytes, check): the run is the input partition, the row its place in the order of reading."""
    own = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.spark_partition_id().alias("run"),
                      F.monotonically_increasing_id().alias("row"))
    return own.select("doc_id", "run", "row", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha"),
                      F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"))


def run_entries(rows: DataFrame) -> DataFrame:
    """(run, *ADDRESS, best, n): one entry for each distinct text of a run; ``best`` orders by id, then by earliest row."""
    return rows.groupBy("run", *ADDRESS).agg(F.max(F.struct("doc_id", (-F.col("row")).alias("before"))).alias("best"),
                                             F.count(F.lit(1)).alias("n"))


def merged(entries: DataFrame, runs: int, fan: int = FAN) -> DataFrame:
    """(*ADDRESS, best, n) of all runs, numbered 0 to ``runs`` - 1: rounds of merges of ``fan`` neighbouring runs."""
    while runs > 1:
        entries = (entries.withColumn("run", F.floor(F.col("run") / fan)).groupBy("run", *ADDRESS)
                   .agg(F.max("best").alias("best"), F.sum("n").alias("n")))
        runs = -(-runs // fan)
    return entries.drop("run")


def _placed(docs: DataFrame, fan: int) -> DataFrame:
    """``addressed`` rows with the best row and the size of their group."""
    rows = materialize(addressed(docs), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    entries = run_entries(rows)
    groups = merged(entries, runs, fan).where("n > 1")
    back = entries.select("run", *ADDRESS).join(groups, [*ADDRESS])
    own = F.struct("doc_id", (-F.col("row")).alias("before"))
    return (rows.join(back, ["run", *ADDRESS], "left")
            .withColumn("best", F.coalesce("best", own)).withColumn("n", F.coalesce("n", F.lit(1)))
            .withColumn("kept", F.col("best")["before"] == -F.col("row")))


def classes(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs`` (doc_id, text)."""
    return _placed(docs, fan).select("doc_id", F.col("best")["doc_id"].alias("keep_id"), F.col("n").alias("group_size"), "kept",
                                     F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text one."""
    kept = _placed(docs, fan).where("kept").select(F.struct("doc_id").alias("_id"), F.hex("sha").alias("_sha"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct("doc_id").alias("_id"),
                       F.hex(F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))).alias("_sha"))
    return held.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")


ORACLE_SQL = f"""
with rows as (select doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) as text_sha256 from documents),
groups as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from rows group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from rows join groups using (text_sha256)
"""
