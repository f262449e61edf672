"""Shared helpers: intermediate tables, text input, connected components."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.session import stored

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where the repository is at the same path (a cluster
    that installs it, or gets it by --py-files, needs nothing)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) of ``docs``: a null text counts as empty, other columns are left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def map_texts(docs: DataFrame, columns: str, fn: Callable[[], Callable[[list[str]], dict]]) -> DataFrame:
    """(doc_id, *columns) of ``docs`` (doc_id, text): ``fn()`` gives, once a task, the function from a batch of
    texts to the new columns. The ids go through as they are, in Arrow, nulls included."""
    def run(batches):
        work = fn()
        for b in batches:
            new = work(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **new})

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage, survives lost
    executors, and every later pass sees the same rows. Who wants the table deleted makes it inside ``collected``."""
    return stored(df, tag)


SMALL_EDGES = 1 << 17
SMALL_ROUNDS = 3


def _small_round(e: DataFrame) -> DataFrame:
    """A large-star and a small-star step on ``e`` (u, v), u > v, of one partition: windows in place of the joins, so the
    plan reads ``e`` once and has no exchange."""
    def least(rows):
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))

    def pairs(*of):
        return F.inline(F.array(*[F.struct(a.alias("u"), b.alias("v")) for a, b in of]))

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both = e.select(pairs((u, v), (v, u)))
    large = least(both).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(v.alias("u"), m.alias("v")).where("u <> v")
    small = least(large).select(pairs((F.greatest(v, m), F.least(v, m)), (F.greatest(u, m), F.least(u, m))))
    return small.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), component being the
    smallest node it reaches; only nodes that have an edge appear.

    Alternating large-star and small-star steps: every node is relinked to the smallest node of its
    neighbourhood until nothing changes. All steps are joins and min-aggregates on the edges, so a
    node with very many edges costs one partial aggregate and a join that Spark can split. At most
    ``SMALL_EDGES`` edges (a count decides) make one partition, and ``SMALL_ROUNDS`` rounds of the same steps one job of one
    stage: plans of joins, a job each round, would cost the driver far more memory than the edges.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "edges")
    state, now = None, (e.count(),)
    while state != now:
        state = now
        if now[0] <= SMALL_EDGES:
            e = e.coalesce(1)
            for _ in range(SMALL_ROUNDS):
                e = _small_round(e)
            e = materialize(e, "edges").coalesce(1)
        else:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(low.select("u", F.col("m").alias("v"))))
            e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = e.coalesce(1) if now[0] <= SMALL_EDGES else e
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return (stars.select(F.col("u").alias("node"), "component")
            .unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
