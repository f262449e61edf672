"""Mixing sources to target weights by subset-sum budget fitting.

Sizes count words, ``[^\\x20\\x09-\\x0D]+``. Sources, by code point with null last, weigh 1, 2, 3,
repeating, and share all words of the corpus; a source's target stops at ``MAX_EPOCHS`` times its
size and the excess goes to the others by weight. A source then takes floor(target / size) whole
copies of every document; the remaining budget is fitted over its histogram of exact sizes. Of every size first its proportional
share of documents, rounded down; then, in a seeded order in which a size comes the sooner the more its share lost by rounding, one
document more of a size until ``RESERVE`` words or fewer are left; then a bounded-knapsack dynamic programme over the documents
left, which meets the rest exactly whenever some of them sum to it, and else comes as near as they can from below. So the lengths
taken follow the lengths there are. A budget within ``RESERVE`` that this misses is fitted anew over all documents, and one that leaves
out no more than that by what it leaves out. Last, of each
(source, size) the first n documents by seeded hash are taken.

Nothing is collected but sums: sources are ranked, and their targets solved by repeated aggregates, as tables. A task fits the sources
dealt to it one after another, each on a row for each distinct size. Documents are ranked by range partitioning, so that no
(source, size) group, however large, is sorted by one task.

A null text has size 0, a null source is a source of its own; sources without words get target 0;
repeated rows are ranked and taken one by one; an empty table gives an empty result; extra columns
are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import materialize
from transitlake.operators.positional import with_position

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20
RESERVE = 1 << 14


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key in the sources' order: code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (skey, source_size) with ``target``: shares of all sizes by weight, none above ``epochs`` times its size.
    Each round caps the sources that their share exceeds and shares the rest anew; two sums a round leave the cluster."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = materialize(with_position(sources, [], ["skey"], "pos").withColumn("w", weight), "sources")
    own, limit = F.col("source_size") > 0, F.col("source_size") * F.lit(float(epochs))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, known = 0.0, None
    while True:
        free = own & (F.lit(unit) * F.col("w") <= limit)
        got = ranked.agg(F.sum(F.when(free, F.col("w"))).alias("w"), F.sum(F.when(own & ~free, F.col("source_size"))).alias("full"),
                         F.count_if(free).alias("n")).first()
        if not got["n"] or got["n"] == known:
            break
        unit, known = (total - epochs * (got["full"] or 0)) / got["w"], got["n"]
    return ranked.select("skey", "source_size", F.when(own, F.least(limit, F.lit(unit) * F.col("w"))).otherwise(0.0).alias("target"))


def _knapsack(sizes: list[int], left: list[int], rest: int, order, above: bool = False) -> dict[int, int]:
    """Of ``left`` documents of each size, how many sum to ``rest``, or as near to it from below (or from ``above``) as any
    can; sizes are tried in ``order`` until the sum is met. The sums that can be reached are the bits of one integer."""
    if not above:  # no more can be met than there is
        rest = min(rest, sum(s * n for s, n in zip(sizes, left) if s <= rest))
    goal, reach, steps, take = 1 << rest, 1, [], {}
    most = rest + (max(sizes) if above else 0)
    keep = (1 << (most + 1)) - 1
    for i in order:
        size, part = sizes[i], 1
        if not size or size > most:
            continue
        n = min(left[i], most // size)
        while n > 0 and not reach & goal:
            k = min(part, n)
            steps.append((i, k, reach))
            reach |= (reach << (k * size)) & keep
            n -= k
            part *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    if above:
        at = rest + ((reach >> rest) & -(reach >> rest)).bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * sizes[i]
            take[i] = take.get(i, 0) + k
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each size to take for ``budget`` words, as the module's docstring says."""
    sizes, counts = [int(s) for s in sizes], [int(c) for c in counts]
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget <= 0 or total <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return np.array(counts, dtype=np.int64)
    if total - budget <= RESERVE:  # nearly everything: what is left out is fitted instead
        out = _knapsack(sizes, counts, total - budget, np.random.default_rng([seed, budget]).permutation(len(sizes)), above=True)
        return np.array([c - out.get(i, 0) for i, c in enumerate(counts)], dtype=np.int64)
    take = [c * budget // total if s else 0 for s, c in zip(sizes, counts)]
    lost = np.array([(c * budget % total) / total if s else 0.0 for s, c in zip(sizes, counts)])
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    # the first of exponential clocks that run at each size's lost share: a seeded order in proportion to it
    clock = np.random.default_rng([seed, budget]).standard_exponential(len(sizes)) / np.maximum(lost, 1e-12)
    order = clock.argsort(kind="stable")
    for i in order:
        if rest <= RESERVE:
            break
        if lost[i] > 0 and sizes[i] <= rest - RESERVE // 2 and take[i] < counts[i]:
            take[i] += 1
            rest -= sizes[i]
    left = [c - t for c, t in zip(counts, take)]
    for i in order if rest > RESERVE else ():  # few long documents: more of a size than its share
        n = min(left[i], (rest - RESERVE // 2) // sizes[i]) if sizes[i] and rest > RESERVE else 0
        take[i], left[i], rest = take[i] + n, left[i] - n, rest - n * sizes[i]
    more = _knapsack(sizes, left, rest, order)
    missed = rest - sum(sizes[i] * k for i, k in more.items())
    if missed and budget <= RESERVE:
        whole = _knapsack(sizes, counts, budget, order)
        if budget - sum(sizes[i] * k for i, k in whole.items()) < missed:
            take, more = [0] * len(sizes), whole
    for i, k in more.items():
        take[i] += k
    return np.array(take, dtype=np.int64)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``: ``taken`` words, repeats
    counted, of its ``size``."""
    return _mixed(docs.select("doc_id", source_key(F.col("source")).alias("skey"),
                              words(F.col("text")).alias("size")), seed)


def _fitted(hist: DataFrame, seed: int) -> DataFrame:
    """``hist`` (skey, size, count, budget, ...) with ``n_more``: rows come sorted by source, and a task holds those
    of the source that it is at, over as many batches as they take."""
    def counted(rows: pa.Table) -> list[pa.RecordBatch]:
        keys, budgets = rows.column("skey").to_pylist(), rows.column("budget").to_numpy()
        sizes, counts, more = rows.column("size").to_numpy(), rows.column("count").to_numpy(), np.zeros(len(keys), np.int64)
        starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        for at, end in zip(starts, [*starts[1:], len(keys)]):
            more[at:end] = fit(sizes[at:end], counts[at:end], int(budgets[at]), seed)
        return rows.append_column("n_more", pa.array(more)).combine_chunks().to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []  # of one source
        for b in batches:
            keys = b.column("skey").to_pylist()
            if not keys:
                continue
            last = keys.index(keys[-1])
            if held and held[-1].column("skey")[-1].as_py() == keys[-1]:
                held.append(b)
                continue
            done = [*held, b.slice(0, last)]
            if sum(len(x) for x in done):
                yield from counted(pa.Table.from_batches(done))
            held = [b.slice(last)]
        if held:
            yield from counted(pa.Table.from_batches(held))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hist.schema.fields)
    return hist.repartition("skey").sortWithinPartitions("skey", "size").mapInArrow(run, f"{fields}, n_more long")


def _mixed(rows: DataFrame, seed: int) -> DataFrame:
    sized = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))), "sizes")
    hist = materialize(sized.groupBy("skey", "size").count(), "histogram")
    sources = with_targets(hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")))
    full = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = sources.withColumn("full", full).withColumn("budget", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    more = _fitted(hist.join(plan, "skey"), seed).select("skey", "size", "source_size", "target", "full", "n_more")
    ranked = with_position(sized, ["skey", "size"], ["h", *[c for c in ("doc_id", "row_id") if c in rows.columns]], "pos")
    copies = F.col("full") + (F.col("pos") < F.col("n_more")).cast("long")
    return (ranked.join(more, ["skey", "size"])
            .select(*[c for c in rows.columns if c not in ("skey", "size")], "size", "source_size", "target",
                    (F.col("size") * copies).alias("taken"), copies.alias("copies")))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it."""
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row_id")),
                       "rows")
    rows = held.select("row.doc_id", "row_id", source_key(F.col("row.source")).alias("skey"), words(F.col("row.text")).alias("size"))
    taken = _mixed(rows, seed).where("copies > 0").select("row_id", "copies")
    return (held.join(taken, "row_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
