"""License scans by template-markup matching.

A template is license wording with markup: `<<opt>> ... <</opt>>` may be absent, `<<var:N>>` stands for up to N arbitrary words.
Each template is compiled into a small automaton over word tokens; a text is accepted from a word on if the mandatory words follow
each other exactly, with optional regions present or absent and replaceable regions of any wording within their length. Templates are whole
license texts and notices (accepted as a whole or not at all), one-sentence grants and SPDX lines, in `license_texts`.

The same markup is also written as a regular expression over words (`pattern`), for the SQL and the tests.

Defined results: null or empty text has no words, no labels and score 0; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from normlake.llm import common, license_texts
from normlake.llm.license_texts import TEMPLATES
from normlake.llm.op10_decontaminate import FOLD

#: Fixed values of the contract: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

ANY = None


def tokens(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").translate(FOLD).split()] if text else []


class Automaton:
    """Nondeterministic automaton over words: state -> [(word or ANY, state)]; `end` accepts; `free` holds steps without a word."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        at, opened = 0, []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<opt>>":
                opened.append(at)
            elif part == "<</opt>>":
                self.free[opened.pop()].append(at)
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                begin = at
                for _ in range(int(m[1])):
                    at = self._step(at, ANY)
                last = at
                for s in range(begin, last):
                    self.free[s].append(last)
            else:
                for w in tokens(part):
                    at = self._step(at, w)
        self.end = at
        self.start = self._closed({0})

    def _step(self, at: int, word: str | None) -> int:
        self.edges.append([])
        self.free.append([])
        self.edges[at].append((word, len(self.edges) - 1))
        return len(self.edges) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[str], at: int) -> int:
        """End of the longest match that begins at word `at`, or -1."""
        states, end = self.start, -1
        while True:
            if self.end in states:
                end = at
            if at >= len(words) or not states:
                return end
            w = words[at]
            states = self._closed({t for s in states for x, t in self.edges[s] if x is ANY or x == w})
            at += 1


def places(flat: str, phrase: str) -> Iterator[int]:
    """Numbers of the words at which a phrase, blanks around it, stands in a text that begins with a blank."""
    at, done, k = flat.find(phrase), 0, 0
    while at >= 0:
        k += flat.count(" ", done, at)
        done = at
        yield k
        at = flat.find(phrase, at + 1)


def _parts(template: str) -> list[str]:
    """The mandatory runs of a template."""
    return re.split(r"<<opt>>.*?<</opt>>|<<[^>]*>>", template, flags=re.S)


class Scanner:
    """All templates; a text is tried only where a template's anchor, its longest run of mandatory words, occurs. `hints` are words of which
    one stands in every anchor and phrase: a text without any of them is passed over."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.all, self.phrases = [], phrases
        for label, t in templates.items():
            anchor = max(_parts(t), key=lambda p: len(tokens(p)))
            if not tokens(anchor):
                raise ValueError(f"template {label} has no mandatory word")
            # The anchor begins at most so many words behind the place where a match begins.
            before = t[: t.index(anchor)]
            reach = len(tokens(re.sub(r"<<[^>]*>>", " ", before))) + sum(map(int, re.findall(r"<<var:(\d+)>>", before)))
            self.all.append((label, f" {' '.join(tokens(anchor))} ", reach, Automaton(t)))
        # Few words that hit all: the longest word of each, unless one that is there already does.
        self.hints: list[str] = []
        for words in sorted((tokens(a) for _, a, _, _ in self.all), key=len) + [tokens(p) for p in phrases]:
            if not any(h in words for h in self.hints):
                self.hints.append(max(words, key=len))

    def labels(self, words: list[str], flat: str) -> list[tuple[str, int, int]]:
        """(label, first word, end) of the leftmost match at each place of an anchor."""
        out = []
        for label, anchor, reach, a in self.all:
            for k in places(flat, anchor):
                for s in range(max(0, k - reach), k + 1):
                    if (end := a.match(words, s)) > k:
                        out.append((label, s, end))
                        break
        return out


def scan_text(scanner: Scanner, text: str | None) -> tuple:
    words = tokens(text)
    flat = f" {' '.join(words)} "
    if not any(f" {h} " in flat for h in scanner.hints):
        return len(words), 0, None, None, "", "", 0.0
    starts, base = [], set()
    for phrase, label in scanner.phrases.items():
        found = list(places(flat, f" {phrase} "))
        starts += found
        base |= {label} if found else set()
    found = scanner.labels(words, flat)
    labels = base | {f[0] for f in found}
    score = 1.0 if found else 0.5 if base else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs; score: 1 if a template accepts some passage, 0.5 if only base phrases occur, else 0."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = common.once(f"op3{sorted(templates.items())}", lambda: Scanner(templates))
        found = list(zip(*(scan_text(s, t) for t in b.column(1).to_pylist()))) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f, k) for f, k in zip(found, kinds))], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return common.arrow_map(docs.select(key, text), run, f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def pattern(template: str) -> str:
    """A regular expression for words with a blank behind each."""
    out = []
    for part in re.split(r"(<<[^>]*>>)", template):
        if m := re.fullmatch(r"<<var:(\d+)>>", part):
            out.append(f"(?:[^ ]+ ){{0,{m[1]}}}")
        else:
            out.append({"<<opt>>": "(?:", "<</opt>>": ")?"}.get(part) or "".join(f"{w} " for w in tokens(part)))
    return "".join(out)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = {p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p in PHRASES}
    hits = ", ".join(f"list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: {c}) AS p{k}" for k, (p, c) in enumerate(at.items()))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    more = ", ".join(f"CASE WHEN regexp_matches(flat, ' {pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    shown = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')".format
    return f"""
WITH ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS flat, {hits} FROM ws),
l AS (SELECT doc_id, n, {" || ".join(f"p{k}" for k in range(len(PHRASES)))} AS b, [{base}] AS base, [{more}] AS more FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, CAST(list_min(b) - 1 AS BIGINT) AS first_word, CAST(list_max(b) - 1 AS BIGINT) AS last_word,
{shown("base")} AS base_labels, {shown("base || more")} AS labels,
CASE WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM l
"""


ORACLE = _oracle()
