"""Near-duplicate vectors by sorted projection passes.

Only vectors of one label (not null) and one length are compared. Equal vectors become one
representative with a count. In each pass the representatives are ordered lexicographically by a
64-bit string of random-hyperplane hashes; each is compared with the next ``WINDOW`` in that order,
and pairs with a cosine of ``THRESHOLD`` or more (double precision) are kept. Pairs of all passes
are united into components. Vectors of a label often share a direction, which makes hashes agree that tell nothing:
a sample of each label shows how often the hashes of its unlinked vectors agree, as they are and less their mean, and the number
of passes follows from it, by whichever of the two needs fewer, so that a pair at the threshold meets in some window with
probability ``RECALL``. (Dense spots of unlinked vectors too rare for ``SAMPLE`` vectors to show are not seen.)

Two exact steps follow the passes, whatever the size of the table. The vectors of a label that one window does not hold (where it
does, the first pass compares them all) are compared in block pairs too, so that no pair is left to chance: the links found are all
links. This step is quadratic in a label's vectors; its block pairs are dealt over all tasks. And since a window holds only a part
of a vector's links in a dense cluster, within each component every pair of representatives is compared, in blocks of
``BLOCK`` vectors, of which only the number of links per vector leaves the block.

Nothing grows in one task or in the driver: windows are cut from range partitions into groups of at most
``BLOCK + WINDOW`` rows, components and whole labels into block pairs. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing; neither do those with a null label. Repeated rows each give
a row and count as other vectors; a repeated ``vec_id`` is a row of its own. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import components, materialize
from transitlake.operators.positional import with_position

THRESHOLD = 0.93
WINDOW = 64
BLOCK = 1024
WIDE = 4  # blocks to a side of a block pair in the comparison of whole labels: a row is sent out less often
RECALL = 0.995
SAMPLE = 2048
MOST = 256
SEED = 5


def passes_for(x: np.ndarray, centre: np.ndarray, n: int, most: int, window: int = WINDOW, threshold: float = THRESHOLD,
               recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold was inside some window, for a vector like those of the sample ``x`` (unit
    vectors) among ``n``, when hyperplanes go through ``centre``; more than ``most`` if that many don't do."""
    some, y = x[:256], x - centre
    square = np.maximum((y * y).sum(axis=1), 1e-12)
    cosine = y[:256] @ y.T / np.sqrt(square[:256, None] * square)
    agree = 1 - np.arccos(cosine.clip(-1, 1)) / np.pi
    share = (some @ x.T < threshold) * (n / len(x))  # a linked neighbour fills the window with its own links
    bits, before = np.full(len(some), 64.0), None
    for k in range(64):  # bits that leave as many unlinked vectors as a window holds
        after = np.log(np.maximum(share.sum(axis=1), 1e-9) / window)
        now = (bits == 64) & (after <= 0)
        bits[now] = k if before is None else k - 1 + (before / np.maximum(before - after, 1e-9))[now]
        share, before = share * agree, after
    same = 1 - np.arccos((1 - (1 - threshold) / square[:256]).clip(-1, 1)) / np.pi
    miss = 1 - np.clip(same ** (bits + 1), 0, 1 - 1e-9)
    met = lambda passes: 1 - (miss ** passes).mean()
    low, high = 1, max(2, most)
    if met(high) < recall:
        return high + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if met(mid) >= recall else (mid, high)
    return high


def usable(vector: str = "embedding") -> F.Column:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # before squaring: no overflow, no underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def planned(reps: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """``reps`` with size, and by label and size: passes (none for a vector alone), centre, and whether it is more than a window holds (whole: block pairs follow)."""
    sized = reps.withColumn("size", F.size("v"))
    several = sized.groupBy("label", "size").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(1 << 30)) < F.ceil(F.lit((1 << 30) * SAMPLE) / F.col("many"))
    sample = sized.join(several, ["label", "size"]).where(drawn).select("label", "size", "many", "rid", "v")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        x, n = _unit(rows["v"]), int(rows["many"].iloc[0])
        passes, centre = 1, np.zeros(x.shape[1])
        if n > window + 1:  # else one window holds the label
            passes, centre = min(((passes_for(x, c, n, MOST, window, threshold), c) for c in (centre, x.mean(axis=0))), key=lambda p: p[0])
        return pd.DataFrame({"label": rows["label"].iloc[:1], "size": rows["size"].iloc[:1], "passes": min(passes, MOST),
                             "whole": n > window + 1,
                             "centre": pd.Series([centre.tolist()], index=rows.index[:1], dtype=object)})

    label = reps.schema["label"].dataType.simpleString()
    plans = sample.groupBy("label", "size").applyInPandas(plan, f"label {label}, size int, passes int, whole boolean, centre array<double>")
    return (sized.join(materialize(plans, "plans"), ["label", "size"], "left")
            .withColumn("passes", F.coalesce("passes", F.lit(0))).withColumn("whole", F.coalesce("whole", F.lit(False))))


@functools.lru_cache(maxsize=MOST)
def _planes(seed: int, size: int, at: int) -> np.ndarray:
    return np.random.default_rng([seed, size, at]).standard_normal((size, 64))


def sort_keys(reps: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each representative and pass of its label, with its concatenated hashes as one number.
    ``reps`` as ``planned`` gives them."""
    def keyed(batches):
        for b in batches:
            for (_, size), part in b.groupby(["label", "size"]):
                y = _unit(part["v"]) - np.array(part["centre"].iloc[0])
                for at in range(int(part["passes"].iloc[0])):
                    word = np.packbits(y @ _planes(seed, int(size), at) >= 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
                    key = (word ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the bits' order
                    yield pd.DataFrame({"pass": np.int32(at), "label": part["label"], "size": np.int32(size), "key": key,
                                        "rid": part["rid"], "v": part["v"]})

    label = reps.schema["label"].dataType.simpleString()
    return reps.where("passes > 0").select("rid", "label", "v", "size", "passes", "centre").mapInPandas(
        keyed, f"pass int, label {label}, size int, key long, rid string, v array<double>")


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for each other member of the components that the pairs (a, b) of places below ``n`` make."""
    top, new = None, np.arange(n)
    while top is None or (top != new).any():
        top = new
        new = top.copy()
        np.minimum.at(new, a, top[b])
        np.minimum.at(new, b, top[a])
        new = new[new]
    used = np.flatnonzero(top != np.arange(n))
    return used, top[used]


def window_pairs(keyed: DataFrame, window: int = WINDOW, block: int = BLOCK, threshold: float = THRESHOLD, stars: bool = True) -> DataFrame:
    """Pairs (a, b) that connect what the verified pairs of representatives at most ``window`` apart in some pass's order
    connect: from each block its components as ``stars``, which are no more pairs than rows, or else the verified pairs themselves."""
    ordered = with_position(keyed, [], ["pass", "label", "size", "key", "rid"], "pos")
    own = F.floor(F.col("pos") / block)
    cut = ordered.select("*", F.explode(F.when((F.col("pos") % block < window) & (own > 0), F.array(own, own - 1))
                                        .otherwise(F.array(own))).alias("block"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        first = rows["pos"].to_numpy() // block == rows["block"].iloc[0]
        out = []
        for _, g in rows.groupby(["pass", "label", "size"], sort=False):
            x, at = _unit(g["v"]), g["rid"].to_numpy()
            left, found = first[g.index], []
            for d in range(1, min(window, len(g) - 1) + 1):
                hit = np.nonzero(((x[:-d] * x[d:]).sum(axis=1) >= threshold) & left[:-d])[0]
                found.append((hit, hit + d))
            a, b = (np.concatenate(side) for side in zip(*found)) if found else (np.zeros(0, int),) * 2
            if stars:
                a, b = _stars(a, b, len(g))
            out.append(pd.DataFrame({"a": at[a], "b": at[b]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="str")

    pairs = cut.groupBy("block").applyInPandas(compare, "a string, b string")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_pairs(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """The rows of each pair (i, j), i <= j, of blocks of ``block`` rows of a group: a row is sent to the pairs its block is part of."""
    placed = materialize(with_position(rows, group, ["rid"], "pos").withColumn("block", F.floor(F.col("pos") / block)), "members")
    blocks = placed.groupBy(*group).agg(F.max("block").alias("last"))
    tiles = placed.join(blocks, group).select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("o"))
    return tiles.select(*group, "rid", "v", "n", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))


def whole_links(reps: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that connect what the links between all representatives of a label and size connect: from each pair
    of ``WIDE`` blocks its components as stars, which are as many pairs as rows however dense the links."""
    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "rid"])
        x, rid = _unit(rows["v"]), rows["rid"].to_numpy()
        k = len(rows) if rows["i"].iloc[0] == rows["j"].iloc[0] else int((rows["block"] == rows["i"].iloc[0]).sum())
        first = 0 if k == len(rows) else k
        used, top = np.zeros(0, int), np.zeros(0, int)
        for at in range(0, k, block):  # a block's links are reduced to stars before the next one's are made
            a, b = np.nonzero(x[at:min(at + block, k)] @ x[first:].T >= threshold)
            used, top = _stars(np.concatenate([used, a + at]), np.concatenate([top, b + first]), len(rows))
        x, y = rid[used].astype(str), rid[top].astype(str)
        return pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x)})

    return (block_pairs(reps.select("label", "size", "rid", "v", "n"), ["label", "size"], WIDE * block)
            .groupBy("label", "size", "i", "j").applyInPandas(connect, "a string, b string").distinct())


def linked_counts(reps: DataFrame, parts: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, links): for each representative of a component, the vectors of its component at the
    threshold or above, itself left out, each counted as often as it occurs."""
    members = reps.join(parts.select(F.col("node").alias("rid"), "component"), "rid")
    tiles = block_pairs(members.select("component", "rid", "v", "n"), ["component"], block)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "rid"])
        x, n, rid = _unit(rows["v"]), rows["n"].to_numpy(), rows["rid"].to_numpy()
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        k = len(rows) if same else int((rows["block"] == rows["i"].iloc[0]).sum())
        near = x[:k] @ (x if same else x[k:]).T >= threshold
        if same:
            np.fill_diagonal(near, False)
            links = near @ n
        else:
            links = np.concatenate([near @ n[k:], near.T @ n[:k]])
        return pd.DataFrame({"rid": rid, "links": links})

    return (tiles.groupBy("component", "i", "j").applyInPandas(count, "rid string, links long")
            .groupBy("rid").agg(F.sum("links").alias("links")))


def near_vectors(vectors: DataFrame, window: int = WINDOW, block: int = BLOCK, threshold: float = THRESHOLD,
                 seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label)."""
    # the address of a vector's content: two 64-bit hashes of label and components, negative zero as zero
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = materialize(vectors.select("vec_id", "label", F.when(usable() & F.col("label").isNotNull(), v).alias("v"))
                       .withColumn("rid", F.when(F.col("v").isNotNull(), F.concat(*[
                           F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "v")), 16, "0") for k in range(2)]))), "vectors")
    reps = materialize(rows.where("rid is not null").groupBy("rid", "label", "v")
                       .agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")), "representatives")
    plan = materialize(planned(reps, window, threshold, seed), "planned")
    pairs = window_pairs(sort_keys(plan, seed), window, block, threshold)
    pairs = materialize(pairs.unionByName(whole_links(plan.where("whole"), block, threshold)).distinct(), "pairs")
    parts = materialize(components(pairs), "components")
    links = linked_counts(reps, parts, block, threshold)
    low = (parts.join(reps.select(F.col("rid").alias("node"), "low"), "node")
           .groupBy("component").agg(F.min("low").alias("component_low")))
    class_of = (reps.select("rid", "n", "low").join(links, "rid", "left")
                .join(parts.withColumnRenamed("node", "rid"), "rid", "left").join(low, "component", "left")
                .select("rid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                        F.coalesce("component_low", "low").alias("component_id")))
    return (rows.select("vec_id", "rid").join(class_of, "rid", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


ORACLE_SQL = f"""
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least_of as (select a, min(b) as low from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id,
    e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) as kept
from embeddings e left join counts c on c.a = e.vec_id left join least_of l on l.a = e.vec_id
"""
