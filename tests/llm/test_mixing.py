import itertools
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from transitlake.llm import mixing
from transitlake.llm.common import on_workers, table
from transitlake.llm.registry import op10_mixing


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 80))
def test_fit_never_exceeds_and_is_close(items, budget):
    sizes, counts = np.array([s for s, _ in items]), np.array([c for _, c in items])
    n = mixing.fit(sizes, counts, budget)
    assert (n >= 0).all() and (n <= counts).all()
    sums = {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(c + 1) for c in counts])}
    best = max(x for x in sums if x <= budget)
    assert (sizes * n).sum() == best


def test_fit_is_exact_on_rich_histograms():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 3000)
    counts = rng.integers(0, 50, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (1, 1000, total // 3, total - 1, total, total + 5):
        assert (sizes * mixing.fit(sizes, counts, budget)).sum() == min(budget, total)


def targets(sizes, weights, epochs=3):
    """Shares of all sizes by weight, one at a time: cap what is above, share the excess again until none is."""
    capped = set()
    while True:
        free = [i for i, z in enumerate(sizes) if z and i not in capped]
        left = sum(sizes) - sum(epochs * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > epochs * sizes[i]}
        if not above:
            return [float(epochs * z) if i in capped else share.get(i, 0.0) for i, z in enumerate(sizes)]
        capped |= above


def solved(spark, sizes):
    rows = spark.createDataFrame([(f"0s{i:05d}", z) for i, z in enumerate(sizes)], "skey string, source_size long")
    return [r["target"] for r in mixing.with_targets(rows).orderBy("skey").collect()]


def test_targets_are_capped_and_reshared(spark):
    on_workers(spark)
    assert np.allclose(solved(spark, [100, 1, 100]), [(201 - 3) / 4, 3.0, (201 - 3) * 3 / 4])
    assert solved(spark, [0, 10]) == [0.0, 10.0] and solved(spark, []) == [] and solved(spark, [0, 0]) == [0.0, 0.0]
    rng = np.random.default_rng(3)
    for sizes in ([1, 10, 100, 1000, 10_000, 100_000], (10 ** rng.uniform(0, 6, 40)).astype(int).tolist()):
        want = targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
        assert np.allclose(solved(spark, sizes), want) and abs(sum(want) - sum(sizes)) < 1e-6 * sum(sizes)


def test_a_source_over_many_batches(spark):
    on_workers(spark)
    docs = [(i, "w " * (1 + i % 700), "ab"[i % 2]) for i in range(1500)] + [(5000, "x y", "0"), (5001, "x", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"], r["taken"])
    want = sorted(map(key, mixing.mix(df).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = mixing.mix(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(map(key, got)) == want and all(abs(x) < 2 for x in check(docs, got).values())


def test_many_sources(spark):
    """As many sources as documents: ranked, solved and fitted without the driver and without a group each."""
    on_workers(spark)
    df = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text", "concat('s', id) as source")
    t = time.time()
    got = mixing.mix(df).agg({"taken": "sum", "size": "sum", "doc_id": "count"}).first()
    assert time.time() - t < 60 and got["count(doc_id)"] == 30_000 and 0 < got["sum(taken)"] <= got["sum(size)"]


def test_lengths_taken_follow_the_lengths_there_are():
    """Sparse lengths: every document has its own, and the budget is part of them."""
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.choice(np.arange(1000, 20_000), 2000, replace=False))
    for share in (0.1, 0.4, 0.8):
        n = mixing.fit(sizes, np.ones(2000, int), int(share * sizes.sum()))
        taken = np.repeat(sizes, n)
        assert taken.sum() == int(share * sizes.sum())
        for q in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert abs((taken <= np.quantile(sizes, q)).mean() - q) < 3 * np.sqrt(q * (1 - q) / len(taken))  # as a fair draw
    other = mixing.fit(sizes, np.ones(2000, int), int(0.4 * sizes.sum()), seed=21)
    same = mixing.fit(sizes, np.ones(2000, int), int(0.4 * sizes.sum()))
    assert (other != same).any()  # the seed selects


def check(docs, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(size(t) for _, t, s in docs if s == n) for n in names}
    goal = dict(zip(names, targets([total[n] for n in names], [i % 3 + 1 for i in range(len(names))])))
    assert len(got) == len(docs)
    by = {d: (size(t), s) for d, t, s in docs}
    taken = dict.fromkeys(names, 0)
    for r in got:
        z, s = by[r["doc_id"]]
        assert r["size"] == z and r["source_size"] == total[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r["taken"] <= 3 * z and (z == 0 or r["taken"] % z == 0)
        taken[s] += r["taken"]
    return {n: goal[n] - taken[n] for n in names}


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = op10_mixing(spark, "/root/testdata/sf0.01").collect()
    assert all(abs(x) < 2 for x in check(docs, got).values())
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, op10_mixing(spark, "/root/testdata/sf0.01").collect()))


def test_nulls_ties_repeats_and_hot_size(spark):
    docs = [(i, "a b c", "hot") for i in range(300)] + [(1000, None, None), (1001, "x " * 9000, None), (1002, "", "e"), (1003, " \t\n", "e"),
                                                        (1004, "p q", "z"), (1005, "é ü k", "z")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, size int, h string")
    check(docs, mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df.unionByName(df))
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}
    twice = mixing.mix(df.unionByName(df)).collect()
    assert sum(r["taken"] for r in twice) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in kept.collect())
    assert len(twice) == 2 * len(docs) and all(r["taken"] <= 3 * r["size"] for r in twice)
