import duckdb
import numpy as np

from transitlake.llm import topk
from transitlake.llm.common import on_workers, table
from transitlake.llm.registry import op7_top_k


def brute(rows, every=50, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    got = sorted(tuple(r) for r in op7_top_k(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    assert sorted(con.execute(topk.ORACLE_SQL).fetchall()) == got


def test_small_blocks_ties_and_defined_cases(spark):
    on_workers(spark)
    rng = np.random.default_rng(2)
    rows = [(i * 5, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(200)]
    rows += [(3000 + i, [1.0] * 6) for i in range(60)] + [(1, None), (2, [float("nan")] * 6), (100000, []), (100001, []), (None, [1.0] * 6),
                                                          (50000, [1.0, 2.0]), (7, [None, 1.0]), (150000, [float("inf")]), (200000, [9.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, m int, tile string")
    got = sorted(tuple(r) for r in topk.top_k(df, block=8, tile=3).collect())
    assert got == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_pruning_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(5)
    blocks = [(np.arange(64) + 64 * i, rng.integers(-20, 20, (64, 8)) + 40 * (i % 4)) for i in range(12)]
    q = rng.integers(1, 20, (7, 8))
    got = topk.search_tile(np.arange(7) + 10_000, q, blocks)
    for i in range(7):
        want = sorted((-int(q[i] @ v), int(d)) for ids, m in blocks for d, v in zip(ids, m))[:5]
        assert [(-s, d) for s, d in got[got.slot == i][["score", "vec_id"]].itertuples(index=False)] == want


def test_huge_components_stay_exact():
    m = np.array([[2 ** 30, 3], [2 ** 30, 4]], dtype=np.int64)
    got = topk.search_tile(np.array([9]), m[:1], [(np.array([1, 2]), m)])
    assert got["score"].tolist() == [2 ** 60 + 12, 2 ** 60 + 9]
