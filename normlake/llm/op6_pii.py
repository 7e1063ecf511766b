"""Personal data by offset-preserving deobfuscation.

Identifiers are found in the text as it stands (the base spans) and again in a normalised copy. The copy is made by transducers, each of
which hands on, for every character it writes, the span of source characters it stands for: look-alike letters and full-width forms become
ASCII, zero-width characters vanish, spelled digits become digits (alone, or mixed with groups of digits, with spelled dots between them as
in an address), and `(at)`, `[dot]`, `name at host dot tld` become `@` and `.`. Spans found in the copy that hold a changed character are
mapped back to the source and added under their kind.

Defined results: null or empty text has no spans; repeated rows are scanned each; offsets are code points of the whole original text;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from normlake.llm import common
from normlake.llm.op10_decontaminate import FOLD

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]")
# A run of digits matches from its first digit or not at all, so that other starts need no trial.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Look-alikes: letter by letter.
_LOOK = dict(zip("аеорсухіјѕԁһԛԝԍβοραικνυАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwgBopaikvuABEKMHOPCTXIJSABEZHIKMNOPTYX"))
#: Full-width ASCII, by rule.
_LOOK |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_GONE = "​‌‍⁠﻿­"
_ODD = re.compile(f"[{re.escape(''.join(_LOOK))}{_GONE}]")
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DOTS = ("dot", "punkt", "punto", "point")
_WORD, _DOTTED = "|".join(sorted(_DIGITS, key=len, reverse=True)), "|".join(_DOTS)
#: Spelled digits and groups of digits, with blanks, commas, hyphens, dots, brackets or a spelled dot between.
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}|[0-9]+)(?:(?:[\s,.()-]{{1,3}}|\s{{1,3}}(?:{_DOTTED})\s{{1,3}})(?:{_WORD}|[0-9]+)(?![^\W_]))+", re.I)
_UNIT = re.compile(rf"({_WORD})|([0-9]+)|({_DOTTED})", re.I)
_GAP = re.compile(r"[\s,]*")
#: Digits that such a run has at least, unless three spelled dots part it into an address.
_LEAST = 7
#: Their names (1), those of dots (2) and of at signs (3), as words of op10's kind.
_ATS = ("at", "arroba", "arobase", "ät")
_NAMED = dict.fromkeys((w.encode() for w in _DIGITS), 1) | dict.fromkeys((w.encode() for w in _DOTS), 2) | dict.fromkeys((w.encode() for w in _ATS), 3)
_PLUS = re.compile(r"(?<![^\W_])plus\s+$", re.I)
# Runs of blanks, and what is before a plain `at`, are tried once, not from each of their characters.
_AT_WORD, _DOT_WORD, _OPEN, _CLOSE = f"(?:{'|'.join(_ATS)})", f"(?:{_DOTTED})", r"[\[({<]\s*", r"\s*[\])}>]"
_AT = re.compile(rf"(?:(?<!\s)\s++)?{_OPEN}{_AT_WORD}{_CLOSE}\s*", re.I)
_DOT = re.compile(rf"(?:(?<!\s)\s++)?{_OPEN}{_DOT_WORD}{_CLOSE}\s*", re.I)
# An address with plain words for its signs, or with some in brackets.
_ANY_DOT = rf"(?:\s+{_DOT_WORD}\s+|\s*{_OPEN}{_DOT_WORD}{_CLOSE}\s*)"
_PLAIN = re.compile(rf"(?<=[A-Za-z0-9_%+.-])(\s+{_AT_WORD}\s+|\s*{_OPEN}{_AT_WORD}{_CLOSE}\s*|@)[A-Za-z0-9-]+(?:(?:{_ANY_DOT}|\.)[A-Za-z0-9-]+)+", re.I)
_PLAIN_DOT = re.compile(_ANY_DOT, re.I)
_BETWEEN = re.compile(r"[\W_]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of leftmost non-overlapping matches that pass; by kind, then start."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    if not _NUMBER.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0") or "0") <= 3 and int(x) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class Tape:
    """Text and, for each of its characters, the span of source characters it stands for and whether that was changed."""

    def __init__(self, text: str):
        self.text, self.first, self.last, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string of one character or none, for each of the edits, which are in order and don't overlap."""
        text, first, last, new, at = [], [], [], bytearray(), 0
        for start, end, by in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:start])
            first += self.first[at:start]
            last += self.last[at:start]
            new += self.new[at:start]
            if by:
                text.append(by)
                first.append(self.first[start])
                last.append(self.last[end - 1])
                new.append(1)
            elif start < end and last:
                new[-1] = 1
            at = end
        self.text, self.first, self.last, self.new = "".join(text), first, last, new


def _odd_edits(text: str) -> list:
    return [(m.start(), m.end(), _LOOK.get(m[0], "")) for m in _ODD.finditer(text)]


def _digit_edits(text: str) -> list:
    out: list = []
    for m in _SPELLED.finditer(text):
        units = list(_UNIT.finditer(text, m.start(), m.end()))
        dots = sum(u[3] is not None for u in units)
        if dots < 3 and (not any(u[1] for u in units) or sum(1 if u[1] else len(u[2] or "") for u in units) < _LEAST):
            continue
        if p := _PLUS.search(text, max(0, m.start() - 8), m.start()):
            out.append((p.start(), p.end(), "+"))
        at = m.start()
        for u, after in zip(units, [*units[1:], None]):
            # Blanks and commas beside a spelled digit go with it; between groups of digits, and behind the last unit, they stay.
            gap = text[u.end() : after.start()] if after else None
            end = after.start() if after and (u[3] or after[3] is None and (u[1] or after[1])) and _GAP.fullmatch(gap) else u.end()
            if u[1]:
                out.append((max(at, u.start()), end, _DIGITS[u[1].lower()]))
            elif u[3]:
                # A spelled dot takes the blanks before it, which its neighbour leaves.
                out.append((at, end, "."))
            elif end > u.end():
                out.append((u.end(), end, ""))
            at = max(end, u.end())
    return out


def _words(text: str) -> tuple[list[bytes], bytes]:
    """The words of a text, lower-cased, and the kind of each (see _NAMED; 0: none)."""
    low = text.lower()
    low = low if text.isascii() else _BETWEEN.sub(" ", low)
    words = low.encode("utf-8", "surrogatepass").translate(FOLD).split()
    return words, bytes(map(_NAMED.get, words, repeat(0)))


def _spelled(words: list[bytes], kinds: bytes) -> bool:
    """Whether a spelled digit stands beside another one, a spelled dot or digits, or a spelled dot between digits."""
    for kind, both in ((1, any), (2, all)):
        at = kinds.find(kind)
        while at >= 0:
            if both(0 <= k < len(words) and (kinds[k] in (1, 2) or words[k].isdigit()) for k in (at - 1, at + 1)):
                return True
            at = kinds.find(kind, at + 1)
    return False


def _sign_edits(text: str, at: bool, dot: bool) -> list:
    """at, dot: whether a word for that sign stands in the text."""
    found = [(m.start(), m.end(), "@") for m in (_AT.finditer(text) if at else ())] + [(m.start(), m.end(), ".") for m in (_DOT.finditer(text) if dot else ())]
    for m in _PLAIN.finditer(text) if at or dot and "@" in text else ():
        found += [(m.start(1), m.end(1), "@")] if m[1] != "@" else []
        found += [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(text, m.end(1), m.end())]
    out: list = []
    for e in sorted(found):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def all_spans(text: str) -> tuple[list, list]:
    """Base spans; all spans: those and the ones found in the normalised text, mapped back. Which words a text has tells what may be undone in it."""
    base, tape = base_spans(text), None
    if not text.isascii() and (e := _odd_edits(text)):
        tape = Tape(text)
        tape.rewrite(e)
    words, kinds = _words(tape.text if tape else text)
    at, dot = 3 in kinds, 2 in kinds
    steps = [_digit_edits] if _spelled(words, kinds) else []
    steps += [lambda t: _sign_edits(t, at, dot)] if at or dot else []
    for edits in steps:
        if e := edits(tape.text if tape else text):
            tape = tape or Tape(text)
            tape.rewrite(e)
    if not tape or not any(tape.new):
        return base, base
    more = {(k, tape.first[a], tape.last[b - 1]) for k, a, b in base_spans(tape.text) if any(tape.new[a:b])}
    return base, sorted({*base, *more})


def shown(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, a count for each kind, base_sha256 and spans."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(t or "") for t in b.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in f[0]) for f in found], pa.int64()) for k in range(4)]
        sha = pa.array([hashlib.sha256(shown(f[0]).encode()).hexdigest() for f in found], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([shown(f[1]) for f in found], pa.string())], names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return common.arrow_map(docs.select(key, text), run, f"`{key}` {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
