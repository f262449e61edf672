import duckdb

from transitlake.llm import preference
from transitlake.llm.common import table
from transitlake.llm.registry import op3_preference_format, preference_pairs

SCHEMA = "pair_id long, turn long, role string, text string, part string"


def brute(chosen, rejected):
    def own(rows):
        out = {}
        for p, t, role, text in rows:
            if p is not None:
                out.setdefault(p, []).append((t is not None, t or 0, role or "", text or ""))
        return {p: sorted(v) for p, v in out.items()}
    c, r = own(chosen), own(rejected)
    rows = []
    draw = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    for p in set(c) | set(r):
        a, b = c.get(p, []), r.get(p, [])
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        rows += [(p, "prompt", x[2], draw(*x[2:]), False) for x in a[:n]]
        rows += [(p, "chosen", x[2], draw(*x[2:]), x[2] == "assistant") for x in a[n:]]
        rows += [(p, "rejected", x[2], draw(*x[2:]), x[2] == "assistant") for x in b[n:]]
    return sorted(rows)


def run(spark, chosen, rejected):
    frames = [spark.createDataFrame([(*x, "z") for x in rows], SCHEMA) for rows in (chosen, rejected)]
    return preference.preference_turns(*frames)


CHOSEN = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", "hi"),
          (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", None), (3, 1, None, "t"), (4, 0, "user", "only chosen"),
          (None, 0, "user", "no pair"), (6, None, "user", "first"), (6, 0, "assistant", "x"), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"),
          (8, 0, "user", "long " * 30000)]
REJECTED = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"), (1, 3, "user", "hi"), (2, 0, "user", "q"), (2, 1, "assistant", "a"),
            (3, 0, "user", ""), (3, 1, "assistant", "t"), (5, 0, "assistant", "only rejected"), (6, None, "user", "first"), (6, 0, "assistant", "y"),
            (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "c"), (8, 0, "user", "long " * 30000), (8, 1, "assistant", "end")]


def test_against_brute_force(spark):
    got = sorted((r["pair_id"], r["segment"], r["role"], r["rendered"], r["loss"]) for r in run(spark, CHOSEN, REJECTED).collect())
    assert got == brute(CHOSEN, REJECTED)


def test_assembled_pairs(spark):
    rows = {r["pair_id"]: r for r in preference.assembled(run(spark, CHOSEN, REJECTED)).collect()}
    one = rows[1]
    assert one["prompt"].count("<|im_start|>") == 2 and one["chosen"].startswith("<|im_start|>assistant\nyes")
    for side in ("chosen", "rejected"):
        under = "".join(one[side][x["start"]:x["end"]] for x in one[f"{side}_loss"])
        assert under.startswith("<|im_start|>assistant") and "user" not in under
    assert rows[2]["chosen"] == rows[2]["rejected"] == "" and rows[4]["rejected"] == "" and rows[5]["prompt"] == ""


def test_marks_in_texts_cannot_open_a_turn(spark):
    got = run(spark, [(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant")], []).collect()[0]["rendered"]
    assert got.count("<|im_start|>") == 1 and got.count("<|im_end|>") == 1


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    conversations = table(spark, sf, "conversations").toPandas()  # noqa: F841
    want = duckdb.sql(preference.ORACLE_SQL).df()
    got = op3_preference_format(spark, sf).toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values)) and len(got) > 100


def test_pairs_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    conversations = table(spark, sf, "conversations").toPandas()  # noqa: F841
    want = duckdb.sql(preference.PAIRS_SQL).df()
    got = preference_pairs(spark, sf).toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values)) and len(got) > 30


def test_large_ids_keep_their_pairs(spark):
    big = 1 << 60
    rows = [(big + k, t, role, f"{t} {k if t else ''}") for k in range(4) for t, role in enumerate(("user", "assistant"))] + [(-2, 0, "user", "x"), (-1, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["segment"]) for r in preference.neighbours(df).collect()}
    assert got == {(big // 2 + k, s) for k in range(2) for s in ("prompt", "chosen", "rejected")} | {(-1, "prompt")}


def test_one_turn_number_for_many_rows(spark):
    rows = [(1, None if i % 2 else 5, "user", f"t{i % 50}") for i in range(3000)]
    assert sorted((r["pair_id"], r["segment"], r["role"], r["rendered"], r["loss"]) for r in run(spark, rows, rows[:10]).collect()) == brute(rows, rows[:10])


def test_empty(spark):
    assert run(spark, [], []).count() == 0
