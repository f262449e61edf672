"""Exact top-k by block-at-a-time pruning.

Vectors become integers, floor(256 x); scores are integer inner products. Rows are cut into blocks of
consecutive ``vec_id`` ranges. A block is one row: its forward index (ids and the matrix of its
vectors) and, for each dimension ("term"), the largest and smallest value in it. For a query, the sum over
dimensions of the larger of q*max and q*min bounds every score in the block. Blocks are visited per
query by falling bound, scored through their forward index, until the bound falls below the query's k-th
score; a block whose bound only ties it is scored too unless all its ids are larger.

Queries (``vec_id`` divisible by ``EVERY``) are packed into blocks of ``QUERIES``; a task takes one query
block and a tile of ``TILE`` document blocks, whose memory is bounded, and hands on k rows a
query. The forward index is copied once for each query block. Null vectors, and those that hold null or non-finite components, take no part; vectors
are scored only against those of the same length; an empty vector scores 0 with its like. A repeated
``vec_id`` is a candidate once for each row, and a query once for each row; a query's own id is never
its candidate. Rows with a null id take no part. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm.common import materialize
from transitlake.operators.positional import with_position

K = 5
EVERY = 50
SCALE = 256
BLOCK = 256
TILE = 64
QUERIES = 2048

_PACKED = "size int, block long, ids binary, m binary"


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, v): the integer vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
            .select("vec_id", F.size("embedding").alias("size"),
                    F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v")))


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Forward indexes: a row for each block of consecutive ids and one vector length."""
    placed = with_position(rows, ["size"], ["vec_id", "v"], "pos").withColumn("block", F.floor(F.col("pos") / block))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        m = np.array(g["v"].tolist(), dtype=np.int64)
        return pd.DataFrame({"size": [g["size"].iloc[0]], "block": [g["block"].iloc[0]],
                             "ids": [g["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    return placed.groupBy("size", "block").applyInPandas(pack, _PACKED)


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.m, np.int64).reshape(len(ids), row.size) if row.size else np.zeros((len(ids), 0), np.int64)


def _exact(values: list[np.ndarray]) -> type:
    """float64 while every sum of products stays an exact integer in it, else Python integers."""
    top = [max(1, int(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))))) for v in values]
    return np.float64 if top[0] * top[1] * max(1, values[0].shape[1]) < 1 << 53 else object


def search_tile(query_ids: np.ndarray, q: np.ndarray, blocks: list, k: int = K) -> pd.DataFrame:
    """The k best candidates of each query among ``blocks``, a list of (ids, matrix)."""
    kind = min((_exact([q, m]) for _, m in blocks), key=lambda t: t is np.float64)
    q = q.astype(kind)
    top = np.array([m.max(axis=0) for _, m in blocks]).astype(kind)
    low = np.array([m.min(axis=0) for _, m in blocks]).astype(kind)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    bound = plus @ top.T + minus @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    first_id = np.array([ids.min() for ids, _ in blocks])
    best = [[] for _ in query_ids]  # (-score, id), ascending, at most k
    live = np.arange(len(query_ids))
    for step in range(len(blocks)):
        at = order[live, step]
        keep = []
        for i, b in zip(live, at):
            if len(best[i]) == k:
                kth = best[i][-1]
                if bound[i, b] < -kth[0]:
                    continue  # so do all later blocks
                if bound[i, b] == -kth[0] and first_id[b] > kth[1]:
                    keep.append((i, -1))
                    continue
            keep.append((i, b))
        live = np.array([i for i, _ in keep], dtype=int)
        if not len(live):
            break
        chosen = np.array([b for _, b in keep])
        for b in np.unique(chosen[chosen >= 0]):
            ids, m = blocks[b]
            who = live[chosen == b]
            scores = q[who] @ m.astype(kind).T
            for i, row in zip(who, scores):
                row, own = (row, ids) if not (ids == query_ids[i]).any() else (row[ids != query_ids[i]], ids[ids != query_ids[i]])
                if not len(row):
                    continue
                cut = np.sort(row)[-min(k, len(row))]
                near = np.nonzero(row >= cut)[0]
                best[i] = sorted(best[i] + [(-int(row[c]), int(own[c])) for c in near])[:k]
    out = [(i, query_ids[i], d, -s) for i in range(len(query_ids)) for s, d in best[i]]
    return pd.DataFrame(out, columns=["slot", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest scores, ties to smaller ids."""
    rows = materialize(integers(vectors), "integers")
    docs = materialize(packed(rows, block), "forward")
    asked = materialize(packed(rows.where(F.col("vec_id") % every == 0), QUERIES), "queries")
    # a stated query set against all rows, in blocks: each tile meets each query block of its length
    docs = docs.withColumn("tile", F.floor(F.col("block") / tile))
    counts = asked.groupBy("size").agg(F.max("block").alias("qlast"))
    tiles = docs.groupBy("size").agg(F.max("tile").alias("tlast"))
    left = (asked.join(tiles, "size").select("size", F.col("block").alias("qb"), "ids", "m",
                                              F.explode(F.sequence(F.lit(0).cast("long"), "tlast")).alias("tile")))
    right = (docs.join(counts, "size").select("size", "tile", "block", "ids", "m",
                                              F.explode(F.sequence(F.lit(0).cast("long"), "qlast")).alias("qb")))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qb": [], "slot": [], "query_id": [], "vec_id": [], "score": [], "size": []}, dtype="int64")
        one = next(a.itertuples())
        ids, q = _matrix(one)
        found = search_tile(ids, q, [_matrix(r) for r in b.sort_values("block").itertuples()], k)
        return found.assign(qb=one.qb, size=one.size)

    found = (left.groupBy("size", "qb", "tile").cogroup(right.groupBy("size", "qb", "tile"))
             .applyInPandas(search, "size int, qb long, slot int, query_id long, vec_id long, score long"))
    w = Window.partitionBy("size", "qb", "slot", "query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE_SQL = """
with part as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score
    from part q join part d on q.vec_id <> d.vec_id and len(q.v) = len(d.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
"""
