import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from transitlake.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {c for c, bad in zip("ABCD", (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                                         100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text))) if bad}


def brute(docs, labels):
    """docs (id, text, lang); applies the filters one after another in every order."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = {}
    for i, t, lang in docs:
        bad = fails(t or "") | ({"E"} if i is not None and i > first[t or ""] else set())
        flags = [any(lab[k] == 1 for lab in labels if lab[0] == i and i is not None) for k in (1, 2)]
        rows.setdefault(lang or "", []).append((bad, *flags))
    out = {}
    for part, all_ in rows.items():
        for order in itertools.permutations("ABCDE"):
            alive = list(all_)
            for step, f in enumerate(order):
                gone = [r for r in alive if f in r[0]]
                alive = [r for r in alive if f not in r[0]]
                out[part, "".join(order), step + 1] = [
                    len(alive), len(gone), sum(f in r[0] for r in all_) - len(gone), sum(r[0] == {f} for r in all_),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for f in "ABCDE":
            keys = [(part, "".join(o), o.index(f) + 1) for o in itertools.permutations("ABCDE")]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def as_dict(df):
    names = [*fa.COUNTERS, "shapley"]
    got = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got}
    assert len(out) == len(got)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abAB \t\n\r\x0b\x0c\x1c\x85\xa0é#|🎉"), max_size=60), st.integers(0, 60))
def test_mask_of_a_text(text, n):
    text += " w" * n + " x y z" * (2 * n)
    mask = fa.text_mask(text.encode(), len(text))
    assert {c for i, c in enumerate("ABCD") if mask >> i & 1} == fails(text)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 31), st.integers(0, 1), st.integers(0, 1)), st.integers(0, 1 << 56), max_size=12))
def test_fields_do_not_run_over(cases):
    total = sum(n * fa.packed(*c) for c, n in cases.items())
    want = sum((n * fa.outcomes(*c).astype(np.int64) for c, n in cases.items()), np.zeros((120, 5, 6), np.int64))
    assert (fa.unpacked(fa.as_bytes(total)) == want).all()


LONG = " ".join(f"w{i}" for i in range(120))
DOCS = [(1, LONG, "en"), (2, LONG, "fr"), (3, None, None), (4, "", ""), (5, "AB" * 9, "en"), (6, LONG + " |", "en"), (7, "a " * 300, "fr"),
        (7, "a " * 300, "fr"), (8, "a " * 300, None), (None, LONG, "en"), (0, "AB" * 9, "fr"), (9, LONG + " x" * 200_000, "de")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (6, 1, 0), (7, 0, 1), (8, 7, 1), (None, 1, 1), (99, 1, 1)]


def frames(spark, docs, labels=LABELS, parts=3):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, mask int, part string")
    return d.repartition(parts), spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, part string")


def test_defined_cases(spark):
    d, lab = frames(spark, DOCS)
    assert as_dict(fa.audit(d, lab)) == brute(DOCS, LABELS)
    assert fa.audit(d.limit(0), lab).count() == 0
    none = [(*r[:1], None, None) for r in LABELS]
    assert as_dict(fa.audit(*frames(spark, DOCS, none))) == brute(DOCS, none)


def test_a_group_of_copies_over_many_partitions_and_many_parts(spark, monkeypatch):
    docs = [(i, LONG if i % 3 else f"T{i}" * 40, f"l{i % 7}") for i in range(600)]
    monkeypatch.setattr(fa, "SPREAD", 4)
    d, lab = frames(spark, docs, parts=23)
    assert as_dict(fa.audit(d, lab)) == brute(docs, LABELS)


def test_held_parts_are_bounded(spark):
    docs = [(i, "a b", f"l{i}") for i in range(2 * fa.HELD + 5)]
    d, lab = frames(spark, docs, parts=1)
    got = fa.audit(d, lab)
    assert got.count() == 600 * len(docs)
    assert got.where("step = 1 and filter_order = 'EABCD'").groupBy().sum("removed").first()[0] == len(docs) - 1
