r"""Filter interaction audit: what each filter removes at each place of each order, by wide packed counters.

Five filters, each a condition under which a text fails (words are maximal ``[^\x20\x09-\x0D]+``, case-sensitive):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * ``[A-Z]`` > 10 * code points; D holds any of ``#$%&*|``;
E identical to the text of any smaller doc_id in the table, removed or not.

A document's outcome at every step of every order depends only on its mask of failed filters and its two labels. Each of those
128 cases maps to one big integer whose 64-bit fields hold the ``COUNTERS`` of all 600 steps (120 orders of 5); a task adds up
the integers of its documents by part, tasks' sums are added in two levels, and the fields are unpacked at the end. A field is at most the
number of documents, below 2^63, so no field runs over into the next.

What moves: one row of 29 KB for each part and task, dealt over ``SPREAD`` sums a part before the last one, each added up row by row
and never held as a group. Equal texts meet by SHA-256 and length: every input partition makes one entry a distinct text, so a
group of copies of any size is a row a partition.

A null text counts as empty, a null lang as the empty string. A null doc_id has no smaller one, is none, and has no labels. Of
repeated rows none is smaller than the other. Repeated labels of a document: a 1 holds. Other label values count as 0. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELDS = len(ORDERS) * len(FILTERS) * len(COUNTERS)
SPREAD = 256
HELD = 256
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]").search


def text_mask(raw: bytes, chars: int) -> int:
    """Bits 0 to 3: which of A to D the text fails. ``bytes.split`` cuts at exactly the six blanks that end a word."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * chars, _MARKS(raw) is not None)
    return sum(bit << i for i, bit in enumerate(fails))


def outcomes(mask: int, good: int, toxic: int) -> np.ndarray:
    """One document's counters at each (order, step): shape (120, 5, len(COUNTERS))."""
    out = np.zeros((len(ORDERS), len(FILTERS), len(COUNTERS)), dtype=np.uint64)
    for o, order in enumerate(ORDERS):
        gone = False
        for step, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            here = fails and not gone
            gone = gone or fails
            out[o, step] = (not gone, here, fails and not here, mask == bit, here and good, here and toxic)
    return out


@functools.cache
def packed(mask: int, good: int, toxic: int) -> int:
    """The big integer of one case: field k holds counter k in 64 bits."""
    return int.from_bytes(outcomes(mask, good, toxic).astype("<u8").tobytes(), "little")


def as_bytes(total: int) -> bytes:
    return total.to_bytes(8 * FIELDS, "little")


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").astype(np.int64).reshape(len(ORDERS), len(FILTERS), len(COUNTERS))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, key, n_bytes, run): filters A to D of each text, and the text's address."""
    plain = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                        F.spark_partition_id().alias("run"))

    def run(batches):
        for b in batches:
            raws = [(t.encode(), len(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "part": b.column("part"), "mask": pa.array([text_mask(*r) for r in raws], pa.int32()),
                "key": pa.array([hashlib.sha256(r).digest() for r, _ in raws], pa.binary()),
                "n_bytes": pa.array([len(r) for r, _ in raws], pa.int64()), "run": b.column("run")})

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, part string, mask int, key binary, n_bytes long, run int")


def with_copies(rows: DataFrame) -> DataFrame:
    """``masked`` rows with filter E in the mask: entries by run and text, the smallest id over all runs, and back."""
    text = ["key", "n_bytes"]
    entries = rows.groupBy("run", *text).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    shared = entries.groupBy(*text).agg(F.min("low").alias("low"), F.sum("n").alias("n")).where("n > 1").drop("n")
    back = entries.select("run", *text).join(shared, text)
    copy = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    return (rows.join(back, ["run", *text], "left")
            .select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row a document."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def task_sums(cases: DataFrame) -> DataFrame:
    """(part, salt, total): the packed sums of each task by part; at most ``HELD`` parts are held at a time."""
    def run(batches):
        sums: dict[str, int] = {}

        def rows():
            got = pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.string()), "salt": pa.array([salt] * len(sums), pa.int32()),
                                              "total": pa.array([as_bytes(v) for v in sums.values()], pa.binary())})
            sums.clear()
            return got

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("part", "mask", "good", "toxic")]
            salt = b.column("salt")[0].as_py() if len(b) else 0
            for (part, mask, good, toxic), n in Counter(zip(*cols)).items():
                sums[part] = sums.get(part, 0) + n * packed(mask, good, toxic)
                if len(sums) >= HELD:
                    yield rows()
        if sums:
            yield rows()

    salted = cases.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    return salted.mapInArrow(run, "part string, salt int, total binary")


def added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(part, salt, total) by ``keys``: rows come sorted by them and are added one after another."""
    def run(batches):
        now, total = None, 0
        for b in batches:
            for row in b.to_pylist():
                key = (row["part"], row["salt"])
                if now is not None and key != now:
                    yield one(now, total)
                    total = 0
                now, total = key, total + int.from_bytes(row["total"], "little")
        if now is not None:
            yield one(now, total)

    def one(key, total):
        return pa.RecordBatch.from_pydict({"part": pa.array([key[0]], pa.string()), "salt": pa.array([key[1]], pa.int32()),
                                           "total": pa.array([as_bytes(total)], pa.binary())})

    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "part string, salt int, total binary")


def steps(totals: DataFrame) -> DataFrame:
    """The 600 rows of each part."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fields = unpacked(row["total"])
                removed = fields[:, :, COUNTERS.index("removed")]
                shapley = {f: int(sum(removed[o, order.index(f)] for o, order in enumerate(ORDERS))) for f in FILTERS}
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * (len(ORDERS) * len(FILTERS)), pa.string()),
                    "filter_order": [o for o in ORDERS for _ in FILTERS],
                    "step": pa.array([s + 1 for _ in ORDERS for s in range(len(FILTERS))], pa.int32()),
                    **{c: fields[:, :, k].ravel() for k, c in enumerate(COUNTERS)},
                    "shapley": pa.array([shapley[f] for o in ORDERS for f in o], pa.int64())})

    longs = ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))
    return totals.mapInArrow(run, f"part string, filter_order string, step int, {longs}")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, *COUNTERS, shapley) of ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic)."""
    rows = with_copies(materialize(masked(docs), "masks"))
    flags = label_flags(labels)
    cases = rows.join(flags, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    spread = added(task_sums(cases), ["part", "salt"])
    return steps(added(spread.withColumn("salt", F.lit(0)), ["part"]))


_MASK_SQL = r"""
texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
firsts as (select text, min(doc_id) as low from texts group by text),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from texts join firsts using (text)),
flags as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cases as (select part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(doc_id > low, false)} as f, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
    from words left join flags using (doc_id)),
counted as (select part, [x for x in ['A', 'B', 'C', 'D', 'E'] if case x when 'A' then f.A when 'B' then f.B when 'C' then f.C
        when 'D' then f.D else f.E end] as fails, count(*) as n, sum(good) as g, sum(toxic) as t from cases group by all)"""

ORACLE_SQL = f"""
with {_MASK_SQL},
letters(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places as (select filter_order, cast(step as integer) as step, filter_order[step] as x, filter_order[1:step - 1] as before from orders, range(1, 6) r(step)),
parts as (select distinct part from counted),
steps as (select part, filter_order, step, x,
    sum(case when list_contains(fails, x) or list_bool_or([contains(before, y) for y in fails]) then 0 else n end) as kept,
    sum(case when list_contains(fails, x) and not coalesce(list_bool_or([contains(before, y) for y in fails]), false) then n else 0 end) as removed,
    sum(case when list_contains(fails, x) and list_bool_or([contains(before, y) for y in fails]) then n else 0 end) as redundant,
    sum(case when fails = [x] then n else 0 end) as unique_fails,
    sum(case when list_contains(fails, x) and not coalesce(list_bool_or([contains(before, y) for y in fails]), false) then g else 0 end) as good_lost,
    sum(case when list_contains(fails, x) and not coalesce(list_bool_or([contains(before, y) for y in fails]), false) then t else 0 end) as toxic_lost
    from counted, places group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley
from steps
"""
