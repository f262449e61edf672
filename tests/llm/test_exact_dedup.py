import hashlib
import random

import pytest

from transitlake.llm import exact_dedup as ed


def norm(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    return sorted(((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]),
                    hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs), key=str)


def frame(spark, docs, parts):
    return spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, run int, sha string, best int").repartition(parts)


def check(docs, got):
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(docs)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({norm(t) for _, t in docs})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


DOCS = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, " "), (7, "x" * 3_000_000), (8, "X" * 3_000_000), (9, "tie"), (9, "TIE"),
        (None, "only"), (None, "ONLY"), (None, "abc É"), (-3, "neg"), (-7, "NEG"), (10, "İstanbul"), (11, "istanbul"), (12, "a\u0000b"), (13, "A\u0000B")]


@pytest.mark.parametrize("parts", [1, 3, 19])
@pytest.mark.parametrize("fan", [2, 16])
def test_defined_cases(spark, parts, fan):
    check(DOCS, ed.classes(frame(spark, DOCS, parts), fan).collect())


def test_empty(spark):
    df = frame(spark, DOCS, 1).limit(0)
    assert ed.classes(df).count() == 0 and ed.deduplicated(df).count() == 0


def test_large_groups_over_many_runs(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Hot", "hot", "HOT"]) if i % 3 else f"t{i % 40}") for i in rng.sample(range(9000), 4000)]
    check(docs, ed.classes(frame(spark, docs, 37), 4).collect())


def test_a_merge_takes_fan_runs_of_neighbours(spark):
    rows = spark.createDataFrame([(r, bytes([k]), 1, k, r * 10 + k, 0) for r in range(11) for k in range(4) if (r + k) % 3],
                                 "run int, sha binary, n_bytes int, check long, doc_id long, row long")
    entries = ed.run_entries(rows)
    for fan in (2, 3, 16):
        got = {bytes(r["sha"])[0]: (r["best"]["doc_id"], r["n"]) for r in ed.merged(entries, 11, fan).collect()}
        want = {k: [r * 10 + k for r in range(11) if (r + k) % 3] for k in range(4)}
        assert got == {k: (max(v), len(v)) for k, v in want.items()}
        text = ed.merged(entries, 11, fan)._jdf.queryExecution().optimizedPlan().toString()
        rounds, runs = 0, 11
        while runs > 1:
            rounds, runs = rounds + 1, -(-runs // fan)
        assert text.count("Aggregate") == 1 + rounds


def test_entries_that_differ_in_length_or_check_stay_apart(spark):
    rows = spark.createDataFrame([(0, b"a", 1, 5, 1, 0), (1, b"a", 2, 5, 2, 0), (1, b"a", 1, 6, 3, 1), (1, b"a", 1, 5, 4, 2)],
                                 "run int, sha binary, n_bytes int, check long, doc_id long, row long")
    got = sorted((r["best"]["doc_id"], r["n"]) for r in ed.merged(ed.run_entries(rows), 2).collect())
    assert got == [(2, 1), (3, 1), (4, 2)]


def test_deduplicated_keeps_rows_and_columns(spark):
    df = frame(spark, DOCS, 3)
    got = ed.deduplicated(df).collect()
    assert got[0].asDict().keys() == df.first().asDict().keys()
    want = {norm(t): max((i for i, u in DOCS if norm(u) == norm(t) and i is not None), default=None) for _, t in DOCS}
    assert sorted(((norm(r["text"]), r["doc_id"]) for r in got), key=str) == sorted(want.items(), key=str)


def test_no_python_on_the_main_path(spark):
    plan = ed.classes(frame(spark, DOCS, 3))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
