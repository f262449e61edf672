import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.llm import common, embed_dedup
from transitlake.llm.common import components, on_workers, table
from transitlake.llm.registry import op5_embedding_near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n int, key string"


def brute(rows):
    """n_links and component of each row by comparing all pairs."""
    def fine(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and la == lb and fine(a, la) and fine(b, lb) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                link[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i]] + [comp[j] for j in np.nonzero(link[i])[0]]) for i in range(n)]
    return sorted((r[0], int(link[i].sum()), comp[i], r[0] == comp[i]) for i, r in enumerate(rows))


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in embed_dedup.near_vectors(df, **how).collect())


def test_whole_table(spark):
    e = table(spark, "/root/testdata/sf0.001", "embeddings").collect()
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in e]
    got = sorted(tuple(r) for r in op5_embedding_near_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)


def linked_by_passes(spark, sf):
    """(pairs of equal label linked by brute force, those of them that the sorted passes alone find), between distinct vectors."""
    on_workers(spark)
    e = table(spark, sf, "embeddings").select("embedding", "label").distinct()
    reps = e.where(embed_dedup.usable() & F.col("label").isNotNull()).select(
        F.hex(F.xxhash64("label", "embedding")).alias("rid"), "label", F.col("embedding").cast("array<double>").alias("v"), F.lit(1).alias("n"))
    plan = embed_dedup.planned(reps)
    found = {(r["a"], r["b"]) for r in embed_dedup.window_pairs(embed_dedup.sort_keys(plan), stars=False).collect()}
    rows, want = reps.collect(), set()
    for label in {r["label"] for r in rows}:
        own = sorted((r["rid"], r["v"]) for r in rows if r["label"] == label)
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= {(own[i][0], own[j][0]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))}
    assert found <= want
    return want, found, plan


@pytest.mark.parametrize("sf,links", [("/root/testdata/sf0.1", 0), ("/root/testdata/check_s", 28633)])
def test_recall_of_the_passes_alone_on_the_given_tables(spark, sf, links):
    if not os.path.isdir(sf):
        pytest.skip("no such table here")
    want, found, plan = linked_by_passes(spark, sf)
    passes = [r["passes"] for r in plan.select("label", "passes").distinct().collect()]
    print(f"RECALL {sf}: {len(found)} of {len(want)}, passes {min(passes)} to {max(passes)}")
    assert len(want) == links and len(found) >= 0.9 * len(want) and max(passes) > 1


def test_the_query_holds_the_passes(spark):
    seen = []
    keys = embed_dedup.sort_keys
    try:
        embed_dedup.sort_keys = lambda reps, seed=5: seen.append(reps.where("passes > 0").count()) or keys(reps, seed)
        op5_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()
    finally:
        embed_dedup.sort_keys = keys
    distinct = table(spark, "/root/testdata/sf0.01", "embeddings").select("embedding", "label").distinct()
    assert seen[0] >= 0.9 * distinct.where("label is not null").count()


def test_whole_table_against_sql(spark):
    want = duckdb.sql(embed_dedup.ORACLE_SQL.replace("from embeddings", "from read_parquet('/root/testdata/sf0.01/embeddings.parquet')")).df()
    got = op5_embedding_near_dedup(spark, "/root/testdata/sf0.01").toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values))


def test_clusters_larger_than_window_and_block(spark):
    on_workers(spark)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(60 if c == 0 else 8):
            rows.append((len(rows) * 3, [float(x) for x in np.float32(centre + 0.08 * rng.standard_normal(16))], c % 2))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    rows += [(2000 + i, [float(x) for x in rng.standard_normal(16).astype(np.float32)], 1) for i in range(60)]
    assert run(spark, rows, window=8, block=16) == brute(rows)


def test_defined_cases(spark):
    on_workers(spark)
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], None), (9, [1.0, 0.0], 1), (10, [1.0, -0.0], 1), (11, [2.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 2),
            (14, [1e-30, 1e-31], 3), (15, [1e30, 1e29], 3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows + [(9, [1.0, 0.0], 1)])[9][1] == 3  # a repeated row is another vector
    assert run(spark, []) == []


def test_recall_on_pairs_just_above_the_threshold(spark):
    on_workers(spark)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, list(map(float, a)), 1), (2 * i + 1, list(map(float, 0.935 * a + np.sqrt(1 - 0.935 ** 2) * b)), 1)]
    got = run(spark, rows)
    assert sum(r[1] for r in got) >= 0.98 * 3000
    assert all(r[1] <= 1 for r in got)


def test_no_pair_is_left_to_chance_in_a_label_of_many_blocks(spark):
    on_workers(spark)
    rng, rows = np.random.default_rng(12), []
    for i in range(1200):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, list(map(float, a)), 1), (2 * i + 1, list(map(float, 0.931 * a + np.sqrt(1 - 0.931 ** 2) * b)), 1)]
    got = run(spark, rows, window=16, block=32)
    assert got == [(i, 1, i - i % 2, i % 2 == 0) for i in range(2400)]


@pytest.mark.parametrize("background", [0.7, 0.85])
@pytest.mark.parametrize("block", [64, 1024])  # passes or all pairs at 0.7
def test_recall_in_a_label_with_a_common_mean(spark, background, block):
    on_workers(spark)
    rng = np.random.default_rng(6)
    mean = np.sqrt(background) * np.eye(64)[0]

    def spread(v):
        v[0] = 0
        return v / np.linalg.norm(v)
    rows, cosine = [], 1 - (1 - 0.935) / (1 - background)  # of the parts beside the mean
    for i in range(1500):
        a = spread(rng.standard_normal(64))
        b = spread(rng.standard_normal(64))
        b = spread(b - (b @ a) * a)
        for j, r in enumerate((a, cosine * a + np.sqrt(1 - cosine ** 2) * b)):
            rows.append((2 * i + j, [float(x) for x in mean + np.sqrt(1 - background) * r], 1))
    x = np.array([r[1] for r in rows])
    want = int((x @ x.T >= 0.93).sum()) - 3000
    got = run(spark, rows, block=block)
    assert 0.98 * want <= sum(r[1] for r in got) <= want and want >= 3000


@pytest.mark.parametrize("edges,want", [
    ([(1, 2), (2, 3), (9, 8), (4, 4)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}),
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(100, i) for i in range(50)] + [(100, 200)], {**{i: 0 for i in range(50)}, 100: 0, 200: 0}),
    ([], {})])
@pytest.mark.parametrize("small", [1 << 17, -1])
def test_components(spark, monkeypatch, edges, want, small):
    monkeypatch.setattr(common, "SMALL_EDGES", small)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
