"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, scheme marks, plus signs,
digits and words that announce an account number. Around each anchor a local parser grows the span
left and right, fixes its boundaries and validates it (host labels, octets, Luhn, mod 97). Each kind keeps the
end of its last match, so matches of a kind never overlap, and a parsed span that fails validation
is skipped whole.

Base kinds: email, ip, card, phone. The method adds ``url`` (from ``://``) and ``account`` (the
identifier after a cue word; an IBAN's check digits must hold). A null text counts as empty;
repeated rows give a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from transitlake.llm.common import map_texts, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("iban", "account", "konto", "kontonummer", "compte", "cuenta", "acct")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_REST = re.compile(r"[^\s\"'<>]+")
_NUMBER = re.compile(r"(?:\s?(?:no|nr|number|num)\b\.?)?[ :#=]{1,3}([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9]){5,33})(?![ -]?[A-Z0-9])")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        a.add_word(mark, (mark if not mark.isdigit() else "digit", len(mark)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_holds(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) by kind, in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys(KINDS, 0)
    last_at = -1
    for end, (kind, width) in _ANCHORS.iter(text):
        i = end - width + 1
        if kind == "digit":
            if i >= after["ip"]:
                m = _DOTTED.match(text, i)
                after["ip"] = m.end()
                _octets(text, m.start(), m.end(), out["ip"])
            if i >= after["card"]:
                m = _SPACED.match(text, i)
                after["card"] = m.end() if m else i + 1
                if m and m.end() - i >= 13:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
        elif kind == "@":
            low = max(after["email"], last_at + 1)
            start = i
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            last_at = i
            if start < i and (m := _HOST.match(text, i + 1)):
                after["email"] = m.end()
                out["email"].append((start, m.end()))
        elif kind == "+":
            if i >= after["phone"] and (m := _DIALLED.match(text, i)):
                after["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "://":
            start = i
            while start > after["url"] and text[start - 1] in _SCHEME:
                start -= 1
            while start < i and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < i and (m := _REST.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if stop > end + 1:
                    after["url"] = stop
                    out["url"].append((start, stop))
        elif i >= after["account"] and (m := _NUMBER.match(text, end + 1)):
            number = re.sub("[ -]", "", m[1])
            iban = number[:2].isalpha()
            if 6 <= sum(c.isdigit() for c in number) and (not iban or len(number) >= 15 and iban_holds(number)):
                after["account"] = m.end()
                out["account"].append(m.span(1))
    return out


def _octets(text: str, start: int, end: int, found: list) -> None:
    """Every four numbers of a dotted chain, from the left."""
    if text.count(".", start, end) < 3:
        return
    parts, at = text[start:end].split("."), start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k:k + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            found.append((at, at + size))
        at += size + 1


def joined(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts of the base kinds, the digest of the base spans
    and all spans as ``kind:start:end`` by kind, then start."""
    docs = texts(docs)

    def scan(batch):
        found = [find(t) for t in batch]
        return {**{f"n_{k}": [len(f[k]) for f in found] for k in BASE},
                "base_sha256": [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found],
                "spans": [joined(f, KINDS) for f in found]}

    return map_texts(docs, "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string", lambda: scan)
