r"""Fill-in-the-middle transformation on piece tables.

A document is a piece table: a list of descriptors (buffer, start, end) over two immutable buffers, its UTF-8 text and the
sentinels. Cutting splits a descriptor in two; an arrangement permutes the three pieces and puts sentinel descriptors between
them; the inverse permutation restores them; a hash streams the descriptors' bytes. No piece is copied until an output is asked
for, so a text of any length costs its own bytes and a handful of numbers.

A text is cut in units ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``, left to right, n of them. h1 to h4 are the
first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``. The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger. A text stays plain if it is empty or holds a sentinel, or if
h3 % 100 >= rate; otherwise its form is spm (suffix, prefix, middle) if h4 % 100 < spm, else psm (prefix, suffix, middle).

A null text counts as empty; a null id is written as the empty string in the hash's input; repeated rows give equal rows;
extra columns are ignored; an empty table gives an empty result. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from transitlake.llm.common import texts

SEED, RATE, SPM = 42, 50, 80
# The sentinels of prefix, suffix and middle, in one buffer, and the order of the pieces in each form.
SENTINELS = b"<P><S><M>"
MARKS = {"prefix": (0, 3), "suffix": (3, 6), "middle": (6, 9)}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PIECES = ("prefix", "middle", "suffix")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(raw: bytes) -> np.ndarray:
    """Where each unit of ``raw`` ends, in bytes: after every run of other characters, and at a blank end."""
    if not raw:
        return np.zeros(0, dtype=np.int64)
    blank = _SPACE[np.frombuffer(raw, np.uint8)]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(raw))


class Pieces:
    """A piece table: descriptors (buffer, start, end) over immutable buffers."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, raw: bytes) -> Pieces:
        return cls((raw, SENTINELS), [(0, 0, len(raw))])

    def cut(self, at: int) -> Pieces:
        """The same bytes, with a boundary between pieces after ``at`` bytes."""
        out, seen = [], 0
        for buffer, start, end in self.pieces:
            inner = start + at - seen
            out += [(buffer, start, inner), (buffer, inner, end)] if start < inner < end else [(buffer, start, end)]
            seen += end - start
        return Pieces(self.buffers, out)

    def split(self, *at: int) -> list[Pieces]:
        """The runs of pieces between the (rising) places ``at``."""
        cut = self
        for place in at:
            cut = cut.cut(place)
        out, seen = [[] for _ in range(len(at) + 1)], 0
        for piece in cut.pieces:
            size = piece[2] - piece[1]
            if size:
                out[sum(place <= seen for place in at)].append(piece)
            seen += size
        return [Pieces(self.buffers, run) for run in out]

    def chunks(self):
        for buffer, start, end in self.pieces:
            yield memoryview(self.buffers[buffer])[start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for chunk in self.chunks():
            h.update(chunk)
        return h.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.chunks())

    def chars(self) -> int:
        """Code points: bytes that do not continue one."""
        return sum(int(((np.frombuffer(c, np.uint8) & 0xC0) != 0x80).sum()) for c in self.chunks())


def arrange(named: dict[str, Pieces], form: str) -> Pieces:
    """Each piece behind its sentinel, in the order of ``form``."""
    buffers = next(iter(named.values())).buffers
    return Pieces(buffers, [d for name in ORDERS[form] for d in [(1, *MARKS[name]), *named[name].pieces]])


def restore(output: bytes, form: str) -> Pieces:
    """The original text as pieces of ``output``: the sentinels cut it, the inverse permutation orders what they name."""
    whole = Pieces.of(output)
    if form == "plain":
        return whole
    found, at = {}, 0
    places = []
    for name in ORDERS[form]:
        start, end = MARKS[name]
        at = output.index(SENTINELS[start:end], at)
        places += [at, at + end - start]
        at += end - start
    runs = whole.split(*places)
    for i, name in enumerate(ORDERS[form]):
        found[name] = runs[2 * i + 2]
    return Pieces(whole.buffers, [d for name in PIECES for d in found[name].pieces])


def draws(doc_id, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def transform(doc_id, raw: bytes, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, dict[str, Pieces] | None, Pieces]:
    """(n, form, pieces by name, output as pieces) of one text."""
    ends = unit_ends(raw)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    if not raw or h3 % 100 >= rate or any(SENTINELS[a:b] in raw for a, b in MARKS.values()):
        return n, "plain", None, Pieces.of(raw)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(ends[k - 1]) if k else 0 for k in (first, second)]
    named = dict(zip(PIECES, Pieces.of(raw).split(*at)))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, named, arrange(named, form)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, with_text: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output) for each row of ``docs``
    (doc_id, text); ``output``, the transformed text, only ``with_text``."""
    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n, form, named, out = transform(doc_id, text.encode(), seed, rate, spm)
                raw = out.render()
                rows.append((n, form, named and named["prefix"].chars(), named and named["middle"].chars(), out.sha256(),
                             restore(raw, form).sha256(), *([raw.decode()] if with_text else [])))
            cols = list(zip(*rows)) or [()] * (7 if with_text else 6)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["doc_id", *[f"c{i}" for i in range(len(cols))]])

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if with_text else [])]
    kinds = ["long", "string", "long", "long", "string", "string", "string"]
    plain = texts(docs)
    out = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, "
                           + ", ".join(f"c{i} {k}" for i, k in zip(range(len(names)), kinds)))
    return out.toDF("doc_id", *names)


ORACLE_SQL = r"""
with cut as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units from documents),
drawn as (
    select *, len(units) as n, [('0x' || h[8 * i + 1:8 * i + 8])::bigint for i in range(4)] as d from cut),
placed as (
    select *, least(d[1] % (n + 1), d[2] % (n + 1)) as p, greatest(d[1] % (n + 1), d[2] % (n + 1)) as m,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 50 then 'plain'
             when d[4] % 100 < 80 then 'spm' else 'psm' end as form from drawn),
parts as (
    select *, coalesce(array_to_string(units[1:p], ''), '') as a, coalesce(array_to_string(units[p + 1:m], ''), '') as b,
        coalesce(array_to_string(units[m + 1:n], ''), '') as c from placed)
select doc_id, n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(b) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end)
        as output_sha256, sha256(text) as restored_sha256
from parts
"""
