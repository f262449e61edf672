import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transitlake.llm import buckets
from transitlake.llm.common import table
from transitlake.llm.registry import op4_length_buckets


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    got = buckets.boundaries(lengths, counts, k)
    assert len(got) <= k and got == sorted(set(got)) and got[-1] == lengths.max()
    others = [x for x in lengths if x != lengths.max()]
    best = min(padding(lengths, counts, [*c, lengths.max()]) for n in range(min(k, len(lengths))) for c in itertools.combinations(others, n))
    assert padding(lengths, counts, got) == best


def tokens(text):
    """Four visible Latin characters or fewer without a blank between them, or any other visible character."""
    latin = lambda c: "!" <= c <= "~" or "\u00a1" <= c <= "\u024f"
    n = run = 0
    for c in text or "":
        run = run % 4 + 1 if latin(c) else 0
        n += run == 1 or not latin(c) and c not in " \t\n\v\f\r"
    return n


def check(docs, got, longest, count, budget, tokens=tokens):
    size = {}
    for d, t in docs:
        size.setdefault(d, []).append(tokens(t))
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert 0 <= r["length"] <= min(longest, r["boundary"]) and r["start"] == r["segment"] * longest
    assert total == {d: sum(v) for d, v in size.items()}
    assert len(got) == sum(max(1, -(-n // longest)) for v in size.values() for n in v)
    ends = sorted({(r["bucket"], r["boundary"]) for r in got})
    assert len(ends) <= count and [e for _, e in ends] == sorted({e for _, e in ends})
    slots = {}
    for r in got:
        slots.setdefault((r["bucket"], r["boundary"], r["batch"]), []).append(r["slot"])
    last = {b: max(k[2] for k in slots if k[0] == b) for b, _ in ends}
    for (b, end, batch), s in slots.items():
        rows = max(1, budget // max(1, end))
        assert sorted(s) == list(range(len(s))) and (len(s) == rows or batch == last[b] and len(s) < rows)
    hist = {}
    for r in got:
        hist[r["length"]] = hist.get(r["length"], 0) + 1
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    assert sum(r["boundary"] - r["length"] for r in got) == padding(lengths, counts, buckets.boundaries(lengths, counts, count))


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    check(docs, op4_length_buckets(spark, "/root/testdata/sf0.01").collect(), buckets.MAX_LENGTH, buckets.BUCKETS, buckets.BUDGET)


def test_texts_without_blanks_are_cut_and_batched(spark):
    docs = [(i, "語" * 5000 if i % 2 else "x" * 20_000) for i in range(20)]
    got = buckets.packed(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check(docs, got, buckets.MAX_LENGTH, buckets.BUCKETS, buckets.BUDGET)
    assert len(got) == 60 and max(r["length"] for r in got) == 2048
    rows = {}
    for r in got:
        rows[r["bucket"], r["batch"]] = rows.get((r["bucket"], r["batch"]), 0) + r["boundary"]
    assert max(rows.values()) <= buckets.BUDGET


def test_lengths_of_a_tokenizer(spark):
    from transitlake.llm.tokens import token_counts
    docs = [(i, "un peu de texte 語 " * (i * i)) for i in range(30)] + [(77, None)]
    counted = token_counts(spark.createDataFrame(docs, "doc_id long, text string"))
    n = {r["doc_id"]: r["n_tokens"] for r in counted.collect()}
    got = buckets.packed(counted.withColumn("text", F.lit("never read")), longest=500, buckets=4, budget=4000, length="n_tokens").collect()
    check([(d, d) for d in n], got, 500, 4, 4000, tokens=lambda d: n[d])


def test_defined_cases(spark):
    docs = [(i, "a b c") for i in range(200)] + [(300, None), (301, ""), (302, "x " * 1000), (303, "y"), (303, "y"), (None, "p q r s")]
    df = spark.createDataFrame([(*d, 1, "b") for d in docs], "doc_id long, text string, segment int, bucket string")
    check(docs, buckets.packed(df, longest=64, buckets=3, budget=200).collect(), 64, 3, 200)
    assert buckets.packed(df.limit(0)).count() == 0
