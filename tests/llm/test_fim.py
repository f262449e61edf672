import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from transitlake.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from("ab<PSM> \t\n\r\x0b\x0c\x1c\x85\xa0é🎉"), max_size=40)


def brute(i, text, seed=42):
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, digest(text), digest(text), text
    p, m = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return n, form, len(a), len(b), digest(out), digest(text), out


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_units_end_where_the_pattern_ends(text):
    want = [len(text[:m.end()].encode()) for m in UNIT.finditer(text)]
    assert fim.unit_ends(text.encode()).tolist() == want


@settings(max_examples=500, deadline=None)
@given(TEXTS, st.integers(0, 10_000))
def test_outputs_and_round_trips(text, i):
    n, form, named, out = fim.transform(i, text.encode())
    got = (n, form, named and named["prefix"].chars(), named and named["middle"].chars(), out.sha256(),
           fim.restore(out.render(), form).sha256(), out.render().decode())
    assert got == brute(i, text)
    assert fim.restore(out.render(), form).render().decode() == text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_cutting_keeps_the_bytes(raw, at):
    at = sorted(min(x, len(raw)) for x in at)
    runs = fim.Pieces.of(raw).split(*at)
    assert [r.render() for r in runs] == [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)])]
    assert all(b is runs[0].buffers[0] for b in (r.buffers[0] for r in runs))  # one immutable buffer


def test_defined_cases(spark):
    docs = [(i, f"one two  three\t{i} é🎉\n") for i in range(60)] + [(100, None), (101, ""), (102, "  \n"), (103, "a <P> b"), (104, "x" * 2_000_000),
                                                                (105, "w " * 500_000), (7, "again a b c"), (7, "again a b c"), (None, "no id here")]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, n int, form string")
    got = [tuple(r) for r in fim.fill_in_middle(df).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(i, t or "")) for i, t in docs), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    short = fim.fill_in_middle(df, with_text=False)
    assert sorted((tuple(r) for r in short.collect()), key=str) == sorted((r[:-1] for r in got), key=str)
    assert fim.fill_in_middle(df.limit(0)).count() == 0 and short.columns[0] == "doc_id"


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert "Exchange" not in fim.fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
