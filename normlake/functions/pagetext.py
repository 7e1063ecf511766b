"""Cleaning a document's pages as plain strings: what text.py says of columns, for the Python workers, where a step costs microseconds.

Results are those of the column functions of the same names. Java's blanks are ASCII here too, and its `$` also stands before a last U+0085.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter

from normlake.functions.text import _BLANKS, BROKEN_NAME, BROKEN_WORD, FOOTNOTE_MARK, HEADER_LENGTH, REGISTER_TOKEN, SHIFT_SPECIALS, WIDE_BLANK, WS

#: What Java calls a blank and an end.
_JAVA, _END = "[ \\t\\n\\x0B\\f\\r]", "\\u0085?\\Z"
RUNS, DIGITS, BLANK_RUN = re.compile(f"{WS}{{2,}}|{WS.replace('[ ', '[', 1)}"), re.compile("[0-9]+"), re.compile(f"{WS}+")
BARE_NUMBER = re.compile(f"[0-9]{{1,4}}{_END}")
NUMBER_FIRST, NUMBER_LAST = re.compile(f"[0-9]{{1,4}}{WS}+{_JAVA.replace('[', '[^', 1)}"), re.compile(f"{WS}[0-9]{{1,4}}{_END}")
SENTENCE_END, LETTER = re.compile(f"[.!?]{_END}"), re.compile("[A-Za-zÄÖÜäöüß]")
WIDE, WORD, NAME = re.compile(WIDE_BLANK), re.compile(BROKEN_WORD), re.compile(BROKEN_NAME)
CONTROL, READABLE = re.compile("[\\x03-\\x08\\x0B\\x0C\\x0E-\\x1F]"), re.compile("[A-Za-zÄÖÜäöüß0-9 .,§()]")
SHIFT = {c: chr(c + 0x1D) for c in range(3, 0x62) if c not in (9, 10, 13)} | {c: v for c, v in SHIFT_SPECIALS.items() if c >= 0x62}
#: Lines looked at at each edge of a page; pages that a document needs for that, and for register pages; share of a document before its tail.
EDGE, EDGE_PAGES, REGISTER_PAGES, TAIL = 3, 4, 40, 0.75


@functools.cache
def _register() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a register's token and of prose; small letters of any script, as ranges."""
    small, ranges = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Ll"], []
    for c in small:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    ll = "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in ranges) + "]"
    return re.compile(REGISTER_TOKEN.removesuffix("$").replace("\\s", _JAVA) + _END), re.compile(f"(?:{ll}{{3,}}{_JAVA}+){{5}}{ll}{{3,}}")


def unshifted(raw: str) -> str:
    if not CONTROL.search(raw):
        return raw
    total, control = len(raw) - sum(map(raw.count, "\n\r\t")), len(CONTROL.findall(raw))
    if total < 50 or control / total < 0.1:
        return raw
    out = raw.translate(SHIFT)
    return out if len(READABLE.findall(out)) / total > 0.85 else raw


def single_layer(raw: str) -> str:
    probe = raw.lstrip(_BLANKS)[:80]
    again = raw.find(probe, 100) if len(probe) >= 40 else -1
    return raw[:again] if again > len(raw) / 3 else raw


def header_like(line: str) -> bool:
    if not 1 <= len(line) <= HEADER_LENGTH or "§" in line or SENTENCE_END.search(line) or not LETTER.search(line):
        return False
    return bool(NUMBER_FIRST.match(line) or NUMBER_LAST.search(line))


def without_running_header(raw: str) -> str:
    at = raw.find("\n")
    if at < 1 or not header_like(raw[:at].strip(_BLANKS)) or header_like(raw[at + 1 :].split("\n", 1)[0].strip(_BLANKS)):
        return raw
    return raw[at + 1 :]


def without_bare_numbers(raw: str) -> str:
    return "\n".join([x for x in raw.split("\n") if not BARE_NUMBER.match(x.strip(_BLANKS))])


def line_form(line: str) -> str:
    return RUNS.sub(" ", DIGITS.sub("#", line)).strip(_BLANKS)


def edges(lines: list[str]) -> set[str]:
    """Forms of up to 80 characters of the lines at both edges."""
    return {f for f in map(line_form, {*lines[:EDGE], *lines[-EDGE:]}) if 1 <= len(f) <= 80}


def without_edges(lines: list[str], junk: set[str]) -> list[str]:
    def led(of: list[str]) -> int:
        return next((k for k, x in enumerate(of[:EDGE]) if (f := line_form(x)) and f not in junk), min(EDGE, len(of)))

    top = lines[led(lines) :]
    return top[: len(top) - led(top[::-1])]


def register_like(text: str) -> bool:
    lines = [x for x in (x.strip(_BLANKS) for x in text.split("\n")) if x]
    if len(lines) < 12 or text.count("§") < 8:
        return False
    token, prose = _register()
    told = [bool(prose.search(x)) for x in lines]
    good = sum(not p and sum(map(bool, map(token.match, t := BLANK_RUN.split(x)))) / len(t) >= 0.7 for x, p in zip(lines, told))
    return good / len(lines) >= 0.6 and sum(told) / len(lines) <= 0.15


def tidied(s: str) -> str:
    """Text in NFKC without soft hyphens, wide blanks, words broken at a line's end and runs of blanks."""
    if not s.isascii():
        s = WIDE.sub(" ", unicodedata.normalize("NFKC", s).replace("\u00ad", ""))
    if "-" in s and "\n" in s:
        s = NAME.sub("-", WORD.sub(r"\1\2", s))
    return RUNS.sub(" ", s).strip(_BLANKS)


def document(pages: list[tuple]) -> list[tuple]:
    """(page, body, small, register) of a document's (page, raw), in order of page and text, nulls first."""
    split = []
    for page, raw in pages:
        raw = single_layer(unshifted(raw or ""))
        body, _, small = raw.partition(FOOTNOTE_MARK)
        split.append((page, without_bare_numbers(without_running_header(body)), small))
    split.sort(key=lambda p: (p[0] is not None, p[0] if p[0] is not None else 0, p[1], p[2]))
    n, junk, out = len(split), set(), []
    if n >= EDGE_PAGES:
        least = max(3, -(-n // 2))
        junk = {f for f, k in Counter(f for _, body, _ in split for f in edges(body.split("\n"))).items() if k >= least}
    for page, body, small in split:
        if junk:
            body = "\n".join(without_edges(body.split("\n"), junk))
        register = n >= REGISTER_PAGES and page is not None and page - 1 >= int(n * TAIL) and register_like(body)
        out.append((page, "", "", True) if register else (page, tidied(body), tidied(small), False))
    return out
