"""Token counts by a two-tier map-side lookup.

A byte-level BPE never merges across pre-tokens, so a text's token count is the sum of its
pre-tokens' token counts. Pre-tokens are looked up with the punctuation glued to them (a run: what stands
between two single blanks). Tier one is a broadcast table of the corpus's most frequent runs and their
token lengths (at most ``FREQUENT`` entries); tier two is a bounded cache in each Python worker that
encodes what the table misses. Pre-tokens are never shuffled: the table comes
from per-task tallies over all rows, each of which hands on at most ``PER_TASK`` entries.
Which runs are in the table changes the speed only, never a count.

Nulls and edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids
give a row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import map_texts, texts

FREQUENT = 1 << 16
PER_TASK = 1 << 12
CACHE = 1 << 19
OVER = 512
LONG = 1 << 16  # characters of a run from which on it goes to the tokenizer: the quick encoder fails on a million blanks in a row

# The pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Outside these ranges the tokenizer's Unicode tables and ours may be of different versions, so a
# text with such a character goes to the tokenizer whole.
_UNSURE = (r"[^\u0000-\u0557\u0559-\u058a\u058d-\u088e\u0890-\u0c5b\u0c5d-\u0cdb"
           r"\u0cdd-\u208e\u20a0-\ua7cd\uab6e-\U000107ba\U0001e700-\U0002b739]")


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# A single blank between two visible characters: pre-tokens never reach across it from the left.
_BLANKS = regex.compile(r"\s\s").search
_GAP = regex.compile(r"(?<=\S) (?=\S)").split


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE model if its ids follow the order of its merges, so that merging by
    the lowest id is merging by the first rule; else None."""
    vocab, letters = model["vocab"], _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get(a + b) for a, b in merges]
    single = {t: i for t, i in vocab.items() if len(t) == 1}
    if None in ids or any(x >= y for x, y in zip(ids, ids[1:])) or len(single) < 256 or max(single.values()) >= min(ids):
        return None
    known = set(ids) | set(single.values())
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if i in known}


def splits_by_pattern(config: dict) -> bool:
    """Whether the tokenizer file cuts texts by ``PATTERN`` and does nothing else to them before its merges."""
    pre = config.get("pre_tokenizer") or {}
    return (config.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True))


class RunCounts:
    """Token counts of texts; one per tokenizer file in each process. Where the file does not cut texts by ``PATTERN``, runs are
    no units of their own and every text goes to the tokenizer whole."""

    _by_path: dict = {}

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_runs = splits_by_pattern(config)
        ranks = ranks_of(config["model"]) if self.by_runs and config["model"].get("type") == "BPE" else None
        self.quick = Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.unsure = regex.compile(_UNSURE).search
        self.frequent: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64) if ranks else None
        for token, i in (ranks or {}).items():
            self.widths[i] = len(token)

    @classmethod
    def get(cls, path: str) -> "RunCounts":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def length(self, run: str) -> int:
        if self.quick and len(run) < LONG:
            return len(self.quick.encode_ordinary(run))
        return self.whole(run)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Number of special tokens, and the texts between them."""
        if self.special is None or not self.special.search(text):
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, [p for p in parts if p]

    def count(self, text: str) -> int:
        if not self.by_runs or self.unsure(text):
            return self.whole(text)
        n, parts = self.parts(text)
        if len(self.cache) > CACHE:
            self.cache.clear()
        frequent, cache = self.frequent, self.cache
        for part in parts:
            first, runs = runs_of(part)
            new = set(runs).difference(frequent).difference(cache)
            if new:
                cache.update(self.lengths(new))
            # a worker's cache outlives a table: a run may be in both tiers and counts once
            n += self.length(first) + sum(map(frequent.get, runs, map(cache.get, runs)))
        return n

    def lengths(self, runs) -> dict[str, int]:
        """Token counts of runs after a blank: they are encoded as one text, and its tokens dealt out by their bytes."""
        alone = [r for r in runs if not r or r[-1].isspace() or len(r) >= LONG] if self.quick else runs
        out = {r: self.length(" " + r) for r in alone}
        runs = [r for r in runs if r not in out]
        if runs:
            token_ends = self.widths[self.quick.encode_ordinary(" " + " ".join(runs))].cumsum()
            run_ends = np.cumsum([len(r.encode()) + 1 for r in runs])
            out.update(zip(runs, np.diff(np.searchsorted(token_ends, run_ends, side="right"), prepend=0).tolist()))
        return out


def runs_of(text: str) -> tuple[str, list[str]]:
    """The text's first run and the others without the blank before them. A run is a pre-token with what is glued to it:
    runs part at single blanks between visible characters."""
    runs = _GAP(text) if _BLANKS(text) else text.split(" ")
    return runs[0], runs[1:]


def frequent_runs(docs: DataFrame, path: str) -> list[str]:
    """The corpus's most frequent runs, from tallies that each task keeps bounded."""
    def tally(batches):
        c = RunCounts.get(path)
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                if c.by_runs and not c.unsure(t):
                    for part in c.parts(t)[1]:
                        seen.update(runs_of(part)[1])
                if len(seen) > CACHE:
                    seen = Counter(dict(seen.most_common(CACHE // 4)))
        top = seen.most_common(PER_TASK)
        yield pa.RecordBatch.from_pydict({"run": pa.array([r for r, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    rows = (docs.select("text").mapInArrow(tally, "run string, n long").groupBy("run")
            .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "run").limit(FREQUENT).collect())
    return [r["run"] for r in rows]


def token_counts(docs: DataFrame, path: str | None = None, over: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``; ``over_limit`` marks more
    than ``over`` tokens. ``path`` is the tokenizer's file."""
    path = path or default_tokenizer_path()
    docs = texts(docs)
    runs = frequent_runs(docs, path)
    table = docs.sparkSession.sparkContext.broadcast(RunCounts.get(path).lengths(runs) if runs else {})

    def start():
        c = RunCounts.get(path)
        c.frequent = table.value
        return lambda batch: {"n_bytes": [len(t.encode()) for t in batch], "n_tokens": [c.count(t) for t in batch]}

    counted = map_texts(docs, "n_bytes long, n_tokens long", start)
    return counted.withColumn("over_limit", F.col("n_tokens") > over)
