"""Packing into optimal length buckets.

Texts are cut into segments of at most ``MAX_LENGTH`` tokens, so nothing is dropped and lengths are bounded. A
dynamic programme over the global histogram of segment lengths chooses the ``BUCKETS`` boundaries that minimise
padding (the sum of boundary - length over all segments). Inside a bucket, segments in a seeded order form
batches of as many rows as fit ``BUDGET`` tokens at the bucket's boundary.

A token is what ``UNIT`` matches, four Latin characters or fewer without a blank, or any other character: a measure that needs no
vocabulary and that a text without blanks cannot slip through. ``packed`` takes token counts of a tokenizer instead, such as those of
``tokens.token_counts``, as a column of ``docs``; a segment is then a run of that tokenizer's tokens.

The histogram has at most ``MAX_LENGTH`` + 1 rows, which is what the driver sees. A bucket may hold any share of the
rows: segments are numbered by range partitioning, so no bucket is gathered in one task. Empty and null texts are one
segment of length 0, null counts too; repeated rows are segments of their own; null ids stay; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import materialize
from transitlake.operators.positional import with_position

UNIT = r"[\x21-\x7E\u00A1-\u024F]{1,4}|[^\x20\x09-\x0D]"
MAX_LENGTH = 2048
BUCKETS = 12
BUDGET = 16_384
SEED = 4


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper ends of at most ``buckets`` length ranges with the least padding; the last is the
    greatest length. Ties go to the smaller boundary."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(x)
    if not n:
        return []
    rows, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):  # the bucket (i, j] pads x[j - 1] - x for each segment
            total = cost[:j] + x[j - 1] * (rows[j] - rows[:j]) - (mass[j] - mass[:j])
            cut[j] = total.argmin()
            new[j] = total[cut[j]]
        cuts.append(cut)
        cost = new
        cost[0] = 0
    ends, j = [], n
    for cut in reversed(cuts):
        if not j:
            break
        ends.append(int(x[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def units(text: Column) -> Column:
    """Tokens of a text by ``UNIT``; 0 of a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(UNIT)), F.lit(0)).cast("long")


def segments(docs: DataFrame, longest: int = MAX_LENGTH, length: str | None = None) -> DataFrame:
    """(doc_id, segment, start, length): runs of at most ``longest`` tokens of each text, which are counted or in column ``length``."""
    n = F.greatest(F.coalesce(F.col(f"`{length}`"), F.lit(0)), F.lit(0)).cast("long") if length else units(F.col("text"))
    sized = docs.select("doc_id", n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0))
    return (sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
            .select("doc_id", "segment", (F.col("segment") * longest).alias("start"),
                    F.least(F.lit(longest), F.col("n") - F.col("segment") * longest).alias("length")))


def packed(docs: DataFrame, longest: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED,
           length: str | None = None) -> DataFrame:
    """(doc_id, segment, start, length, bucket, boundary, batch, slot): ``slot`` is the row's place in batch
    ``batch`` of its bucket, which pads every row to ``boundary`` tokens."""
    cut = materialize(segments(docs, longest, length), "segments")
    hist = sorted((r["length"], r["count"]) for r in cut.groupBy("length").count().collect())
    ends = boundaries(np.array([h[0] for h in hist]), np.array([h[1] for h in hist]), buckets)
    bounds = F.array(*[F.lit(e) for e in ends]) if ends else F.array(F.lit(0))
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("length")))
    placed = cut.withColumn("bucket", bucket).withColumn("boundary", F.get(bounds, F.col("bucket")))
    order = placed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "segment"))
    at = with_position(order, ["bucket"], ["h", "doc_id", "segment", "length"], "pos")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))))
    return at.select("doc_id", "segment", "start", "length", "bucket", "boundary",
                     F.floor(F.col("pos") / rows).alias("batch"), (F.col("pos") % rows).alias("slot"))
