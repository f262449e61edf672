import random

import pytest
from pyspark.sql import functions as F

from transitlake.llm import common
from transitlake.llm.common import components


def run(spark, edges, group="components"):
    """The components of ``edges`` as rows, and how many jobs they took."""
    frame = spark.createDataFrame(edges, "a binary, b binary")
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = sorted((bytes(r["node"]), bytes(r["component"])) for r in components(frame).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def name(i):
    return i.to_bytes(4, "big")


def brute(edges):
    top = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in edges:
        if a in top and b in top:
            top[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((x, root(x)) for x in top)


@pytest.mark.parametrize("seed", [1, 2])
def test_few_edges_have_the_same_components_as_many(spark, monkeypatch, seed):
    rng = random.Random(seed)
    order = rng.sample(range(120), 60)
    edges = [(name(rng.randrange(200, 260)), name(rng.randrange(200, 260))) for _ in range(45)]  # nodes of both sides, itself too
    edges += [(name(a), name(b)) for a, b in zip(order, order[1:])] + [(name(7000), name(8000 + i)) for i in range(50)]
    edges += edges[:9] + [(name(9000), name(9000)), (None, name(1)), (name(201), None)]
    few, _ = run(spark, edges, f"few-{seed}")
    monkeypatch.setattr(common, "SMALL_EDGES", -1)
    many, _ = run(spark, edges, f"many-{seed}")
    assert few == many == brute(edges)


def test_few_edges_take_few_jobs_of_one_stage(spark):
    edges = [(name(i), name(i + 1)) for i in range(60)]
    got, jobs = run(spark, edges, "chain")
    assert got == [(name(i), name(0)) for i in range(61)]
    assert jobs <= 14
    e = spark.createDataFrame(edges, "u binary, v binary").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    plan = common._small_round(common._small_round(e.coalesce(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1
