import public_tokenizers
import pytest
from tokenizers import Tokenizer

from transitlake.llm import tokens
from transitlake.llm.common import on_workers, table
from transitlake.llm.registry import op2_token_counts

SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_whole_table_against_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = op2_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r["doc_id"]] or ""
        n = expected(library, t)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


CASES = [None, "", " ", "  \n\n x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "don't we'll 'S ''s", "٣٤ ½²",
         "日本語 テスト", "naïve café x", "é ́", "👩‍👩‍👧 ok", "\U00018d80 new", "՘x", "\x1c\x85 a",
         "x" * 30000, "ab " * 20000, "\t\r\n" * 50, "a  b", " a b ", "a \n b", "a\n b", "a \nb", "x\u00a0 y z", "\u3000 a", "a \x1f b", "a\x1c b"]


def test_edge_cases(spark, library):
    on_workers(spark)
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(1, "", "x"), (None, "hello", "x")]
    got = tokens.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((i if i is not None else -1, expected(library, t or "")) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got) == want


def test_table_and_cache_do_not_change_counts(spark, monkeypatch, library):
    c = tokens.RunCounts(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in CASES]
    want = [expected(library, t) for t in texts]
    assert [c.count(t) for t in texts] == want
    c.frequent = {"x": c.length(" x"), "ab": c.length(" ab")}
    monkeypatch.setattr(tokens, "CACHE", 0)
    assert [c.count(t) for t in texts] == want


def test_a_run_in_both_tiers_counts_once(library):
    c = tokens.RunCounts(public_tokenizers.path("byte_bpe_50k.json"))
    text = "one two three two"
    assert c.count(text) == expected(library, text)
    c.frequent = c.lengths(["two", "three"])  # the next query's table, in a worker whose cache holds both
    assert c.count(text) == expected(library, text)


def test_a_second_query_in_the_same_workers(spark, library):
    """The first query caches what its table has no room for; the second one's table holds just that."""
    on_workers(spark)
    words = [f"word{i}" for i in range(tokens.PER_TASK + 2000)]
    for some in (words, words[-2500:]):
        rows = [(i, " ".join(some), "x") for i in range(32)]
        got = {r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == {expected(library, rows[0][1])}


def test_a_million_blanks_in_a_row(library):
    c = tokens.RunCounts(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_200_000 + "a", "a b" + "\n" * 1_200_000 + "c d", "a " + "\t" * 1_200_000):
        assert c.count(text) == expected(library, text)


def test_unicode_ranges_split_as_the_library_does(library):
    """Every 7th character of the trusted ranges, before and after letters, digits and blanks."""
    c = tokens.RunCounts(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(0, 0x2c000, 7):
        if 0xd800 <= k < 0xe000:
            continue
        text = f"a{chr(k)}1{chr(k)}  b"
        if not c.unsure(text):
            assert c.count(text) == expected(library, text), hex(k)


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_follow_the_merges():
    assert tokens.ranks_of({"vocab": {"a": 0, "b": 1}, "merges": []}) is None
    assert tokens.RunCounts(public_tokenizers.path("byte_bpe_50k.json")).quick is not None


def test_a_file_with_another_pre_tokenizer_goes_to_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    assert not tokens.RunCounts(path).by_runs and tokens.RunCounts(public_tokenizers.path("byte_bpe_50k.json")).by_runs
    on_workers(spark)
    rows = [(i, t, "x") for i, t in enumerate(CASES)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(rows, SCHEMA), path).collect()}
    assert got == {i: expected(other, t or "") for i, t, _ in rows}
