import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from transitlake.llm import pii
from transitlake.llm.common import on_workers, table
from transitlake.llm.registry import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        s += v if i % 2 == 0 else sum(divmod(2 * v, 10))
    return s % 10 == 0


def good(kind, text):
    digits = "".join(c for c in text if c in "0123456789")
    return {"email": True, "ip": kind == "ip" and all(int(p[-9:]) <= 255 and len(p.lstrip("0")) < 4 for p in text.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in PATTERNS.items()}


def test_whole_table_against_the_patterns(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = op6_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r["n_email"] for r in got) > 3
    for r in got:
        want = brute(docs[r["doc_id"]])
        base = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k])
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="a-Z@.+ 0125()é9_%", max_size=40))
def test_spans_equal_the_patterns(text):
    got = pii.find(text)
    assert {k: got[k] for k in PATTERNS} == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "x@y.zz", "@", "+1 (017) 555-7713", ".", " ", "-", "\n",
                                 "0000000000000", "+", "é", "a@b", "999", "é@a.b"]), max_size=9).map("".join))
def test_joined_pieces_equal_the_patterns(text):
    got = pii.find(text)
    assert {k: got[k] for k in PATTERNS} == brute(text)


def test_added_kinds():
    t = "see https://a.example.com/x?y=1). IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678 and iban DE00370400440532013000"
    got = pii.find(t)
    assert [t[s:e] for s, e in got["url"]] == ["https://a.example.com/x?y=1"]
    assert [t[s:e] for s, e in got["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]


def test_edge_cases(spark):
    on_workers(spark)
    rows = [(1, None, "a"), (2, "", "b"), (None, "q@w.ee", "c"), (2, "", "b"), (5, "x@y.z " * 20000, "d"), (6, "1" * 50000, "e"),
            (7, "1." * 30000 + "1", "f")]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 7 and sum(r["n_email"] for r in got) == 20001 and sum(r["n_ip"] for r in got) == 7500
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_schemes_and_overlong_accounts():
    scheme = "x" + "a-long.scheme+" * 5 + "z"
    for t, url in ((f"see {scheme}://host/x", f"{scheme}://host/x"), (f"12+{scheme}://h", f"{scheme}://h"), ("http://a http://b://c", "http://a"), ("9://h", None)):
        assert [t[s:e] for s, e in pii.find(t)["url"]][:1] == [url][:url is not None]
    assert pii.find("account no. 1" + "2" * 50)["account"] == [] and pii.find("konto 1" + " 23" * 30)["account"] == []
    t = f"account: 1{'2' * 33}, more"
    assert [t[s:e] for s, e in pii.find(t)["account"]] == ["1" + "2" * 33]
