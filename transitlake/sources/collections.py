"""Stored collections: whole versions behind a manifest (S8), upserts of the touched parts (S9), counts of what is
written (M7).

A collection is a folder::

    <root>/data/<version>/_bucket=<k>/*.parquet  rows, dealt to parts by the hash of their key (part 0 without a key)
    <root>/manifest/<number>.json                which folder holds each part, the key, the schema

A write fills a new version folder and adds its manifest last, under a name that appears in one rename. A reader takes the
newest manifest, so it sees the collection before a write or after it, never half of it, and a job may read the collection that it
replaces. An upsert rewrites the parts that its keys fall in; the manifest keeps pointing to the files of all others. There is one
writer at a time. ``vacuum`` deletes what no manifest kept points to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.session import stored

PARTS = 64
ROWS_PER_FILE = 5_000_000
_BUCKET = "_bucket"


class LoadCounts:
    """Row counts that ride on writes. Each is taken in the stage that writes the rows, whose tasks count once
    however often an executor is lost; reading a count waits for that write."""

    def __init__(self):
        self._watched: list[tuple[Observation, list[str]]] = []

    def watch(self, df: DataFrame, weight: Column | None = None, **counts: Column) -> DataFrame:
        """``df``, of which the rows that hold each condition are counted when it is written; a row counts as ``weight`` where given."""
        seen = Observation()
        self._watched.append((seen, list(counts)))
        return df.observe(seen, *[(F.count_if(c) if weight is None else F.sum(F.when(c, weight))).alias(name) for name, c in counts.items()])

    def rows(self) -> dict[str, int]:
        return {name: int(seen.get.get(name) or 0) for seen, names in self._watched for name in names}


@dataclass
class Manifest:
    number: int
    key: str | None
    parts: int
    schema: T.StructType
    paths: dict[int, str] = field(default_factory=dict)  # part to folder below the root

    def text(self) -> str:
        return json.dumps({"key": self.key, "parts": self.parts, "schema": self.schema.jsonValue(),
                           "paths": {str(k): v for k, v in sorted(self.paths.items())}})


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _children(spark, f"{root}/manifest") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest | None:
    """The newest manifest of a collection, or that of a given number; none where nothing was written."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    if not numbers:
        return None
    number = numbers[-1] if number is None else number
    fs, p = _hadoop(spark, f"{root}/manifest/{number:010d}.json")
    stream = fs.open(p)
    try:
        got = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(number, got["key"], got["parts"], T.StructType.fromJson(got["schema"]), {int(k): v for k, v in got["paths"].items()})


def _publish(spark: SparkSession, root: str, m: Manifest) -> None:
    fs, final = _hadoop(spark, f"{root}/manifest/{m.number:010d}.json")
    _, draft = _hadoop(spark, f"{root}/manifest/_{uuid.uuid4().hex}")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(m.text().encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"{root}: manifest {m.number} was written by another job")


def _part(key: str | None, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int") if key else F.lit(0)


def _write_parts(df: DataFrame, root: str, key: str | None, parts: int, rows_per_file: int, counts: LoadCounts | None = None,
                 counted: dict[str, Column] | None = None) -> dict[int, str]:
    """Write ``df`` as a new version below ``root``: the folder of each part that has rows."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    placed = df.withColumn(_BUCKET, _part(key, parts))
    if key and parts > 1:  # a large part spans many tasks, a task writes to few parts
        placed = placed.repartitionByRange(_BUCKET, key)
    if counts is not None and counted:  # after the last shuffle: the rows pass here once
        placed = counts.watch(placed, **counted)
    placed.write.option("maxRecordsPerFile", rows_per_file).partitionBy(_BUCKET).parquet(f"{root}/data/{version}")
    return {int(n.split("=")[1]): f"data/{version}/{n}" for n in _children(spark, f"{root}/data/{version}") if n.startswith(f"{_BUCKET}=")}


def replace_collection(df: DataFrame, root: str, key: str | None = None, parts: int = PARTS, rows_per_file: int = ROWS_PER_FILE,
                       counts: LoadCounts | None = None, counted: dict[str, Column] | None = None) -> None:
    """Make ``df`` the whole content of the collection. ``df`` may read the collection itself. ``counted`` names
    conditions whose rows ``counts`` takes as they are written."""
    root, spark = root.rstrip("/"), df.sparkSession
    parts = parts if key else 1
    last = manifest(spark, root)
    paths = _write_parts(df, root, key, parts, rows_per_file, counts, counted)
    _publish(spark, root, Manifest(last.number + 1 if last else 1, key, parts, df.schema, paths))


def read_collection(spark: SparkSession, root: str, parts: list[int] | None = None, number: int | None = None) -> DataFrame:
    """The collection as of its newest manifest (or of ``number``); ``parts`` reads only their folders."""
    root = root.rstrip("/")
    m = manifest(spark, root, number)
    if m is None:
        raise FileNotFoundError(f"{root} holds no collection")
    paths = [f"{root}/{path}" for k, path in sorted(m.paths.items()) if parts is None or k in parts]
    return spark.read.schema(m.schema).parquet(*paths) if paths else spark.createDataFrame([], m.schema)


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``update_one({key}, {$set: fields}, upsert=True)`` for every update row: a full outer join on the key;
    fields present in ``updates`` take the new value (NULL included, as $set does), others keep the old one;
    keys only in ``updates`` become new documents."""
    cur, upd = current.alias("c"), updates.alias("u")
    joined = cur.join(upd, F.col(f"c.{key}") == F.col(f"u.{key}"), "full_outer")
    hit = F.col(f"u.{key}").isNotNull()
    cols = [F.coalesce(F.col(f"u.{key}"), F.col(f"c.{key}")).alias(key)]
    for c in current.columns:
        if c == key:
            continue
        if c in updates.columns:
            cols.append(F.when(hit, F.col(f"u.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
        else:
            cols.append(F.col(f"c.{c}").alias(c))
    for c in updates.columns:
        if c not in current.columns:
            cols.append(F.col(f"u.{c}").alias(c))
    return joined.select(cols)


def upsert_collection(updates: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE) -> list[int]:
    """Upsert ``updates`` by the collection's key; returns the parts that were rewritten. Only the folders of those
    parts are read and written. New columns read as NULL from the parts left alone."""
    root, spark = root.rstrip("/"), updates.sparkSession
    m = manifest(spark, root)
    if m is None or m.key is None:
        raise ValueError(f"{root} holds no collection with a key")
    updates = stored(updates, "updates")  # read twice, for the parts and for the join
    touched = sorted(r[0] for r in updates.select(_part(m.key, m.parts)).distinct().collect())  # at most ``m.parts`` numbers
    if not touched:
        return []
    merged = upsert(read_collection(spark, root, touched), updates, m.key)
    paths = m.paths | _write_parts(merged, root, m.key, m.parts, rows_per_file)
    _publish(spark, root, Manifest(m.number + 1, m.key, m.parts, merged.schema, paths))
    return touched


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Delete the manifests but the newest ``keep`` and the part folders that those don't name. Not while a write is under way."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    used = {path for n in numbers[-keep:] for path in manifest(spark, root, n).paths.values()}
    for n in numbers[:-keep]:
        fs, p = _hadoop(spark, f"{root}/manifest/{n:010d}.json")
        fs.delete(p, False)
    for version in _children(spark, f"{root}/data"):
        names = [n for n in _children(spark, f"{root}/data/{version}") if n.startswith(f"{_BUCKET}=")]
        gone = [n for n in names if f"data/{version}/{n}" not in used]
        for n in ([""] if len(gone) == len(names) else gone):
            fs, p = _hadoop(spark, f"{root}/data/{version}/{n}".rstrip("/"))
            fs.delete(p, True)
