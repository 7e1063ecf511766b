"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of test questions and answers.

A text is normalised byte by byte (A-Z lowered; every other ASCII byte that is no letter or digit parts words) and its words become numbers
in the benchmark's vocabulary, 0 for all others. The automaton's letters are those numbers: its trie has a path for every window, its edges
are one sorted array (state and word to state), and its failure links lead from a state to the longest shorter suffix that is a state.
A text is scanned once. Places from which three words lead along edges (or to the end of a shorter window) are found for a whole batch at
once; from such a place the automaton runs word by word, with its failure links, until it is back at its root. Hits are runs of words, and
`spans` maps them to code points of the original text.

The automaton takes some 150 bytes for each word of the benchmark, in arrays. A benchmark of more than `block_bytes` is taken in blocks, one
automaton and one scan of the texts for each; a scan of several gives only the hits of texts that have any, by the texts' hashes.

Defined results: null or empty text has no words and no hits; an item without words matches nothing; repeated items and repeated
document rows each count as given (items by distinct item_id); an item whose id is null can hit words but adds no id; an empty
benchmark leaves every document clean; extra columns are ignored by `scan` and kept by `decontaminate`.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import common

WINDOW = 10
#: Bytes of benchmark text in one automaton (some 25 bytes of arrays for each).
BLOCK_BYTES = 8_000_000
#: Words that the search for places to begin looks ahead.
AHEAD = 3
#: Texts with hits, and runs and ids in them, up to which they are broadcast to the documents, where the benchmark has several blocks.
BROADCAST_ROWS, BROADCAST_PARTS = 100_000, 1_000_000
#: Words part at every ASCII byte but letters and digits; bytes from 0x80 on belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words, for counting them in the JVM.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SCHEMA = "n_words bigint, hits array<array<int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows(text: str | None) -> list[bytes]:
    """Space-joined windows of an item: every 10 consecutive words, or all words of a shorter item."""
    w = words(text)
    if not w:
        return []
    return [b" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))]


def blocks(items: Iterator[tuple], most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most `most` bytes of text, or of one item."""
    block, size = [], 0
    for item_id, text in items:
        n = len(text or "")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    if block:
        yield block


class Automaton:
    """States are numbers, the root is 0, and deeper states have greater numbers. An edge's key is state x size + word; as the keys are in
    order of their states, the state that edge k leads to is k + 1."""

    def __init__(self, block: list[tuple[str | None, str]]):
        vocabulary: dict[bytes, int] = {}
        texts = [(item_id, w) for item_id, text in block if (w := words(text))]
        flat = np.fromiter((vocabulary.setdefault(x, len(vocabulary) + 1) for _, w in texts for x in w), np.int64)
        self.vocabulary, self.size = vocabulary, len(vocabulary) + 1
        sizes = np.array([len(w) for _, w in texts], np.int64)
        width = np.minimum(sizes, WINDOW)
        many = sizes - width + 1
        self.names = [item_id for item_id, _ in texts]
        owner = np.repeat(np.arange(len(texts)), many)
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(sizes) - sizes, many)
        length = width[owner]
        # A level of the trie after the other: windows that share a state and go on with the same word share the next state.
        at, keys, levels, word = np.zeros(len(start), np.int64), [], [0, 1], None
        for d in range(int(length.max(initial=0))):
            live = np.flatnonzero(length > d)
            key, which = np.unique(at[live] * self.size + flat[start[live] + d], return_inverse=True)
            at[live] = levels[-1] + which
            keys.append(key)
            levels.append(levels[-1] + len(key))
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        n = len(self.key) + 1
        self.depth = np.repeat(np.arange(len(levels) - 1, dtype=np.int8), np.diff(levels))
        # Windows in order of their last state: the items of a state are neighbours.
        order = np.argsort(at, kind="stable")
        self.last, self.item = at[order], owner[order].astype(np.int32)
        ends = np.zeros(n, bool)
        ends[at] = True
        self.fail, self.said = np.zeros(n, np.int32), np.where(ends, np.arange(n), 0).astype(np.int32)
        for a, z in zip(levels[2:-1], levels[3:]):
            state, word = np.divmod(self.key[a - 1 : z - 1], self.size)
            # The failure link of a state's child: the child by the same word of the state's failure link, or of that one's, and so on.
            link, found, open_ = self.fail[state].astype(np.int64), np.zeros(z - a, np.int64), np.arange(z - a)
            while len(open_):
                child = self.step(link[open_], word[open_])
                found[open_] = child
                open_ = open_[(child == 0) & (link[open_] > 0)]
                link[open_] = self.fail[link[open_]]
            self.fail[a:z] = found
        # The nearest state on the way of failure links, itself included, at which a window ends; links lead to lower levels.
        for a, z in zip(levels[1:-1], levels[2:]):
            none = a + np.flatnonzero(self.said[a:z] == 0)
            self.said[none] = self.said[self.fail[none]]
        self.edges, self.back, self.told = memoryview(self.key), memoryview(self.fail), memoryview(self.said)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states that edges lead to, or 0."""
        key = state * self.size + word
        k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[k] == key, k + 1, 0) if len(self.key) else np.zeros(len(key), np.int64)

    def numbers(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w))

    def begins(self, x: np.ndarray) -> np.ndarray:
        """Places of x from which AHEAD words lead along edges, or fewer to the end of a window. Behind x's last word nothing leads on."""
        place = np.flatnonzero(x)
        state, out = self.step(np.zeros(len(place), np.int64), x[place]), []
        for d in range(1, AHEAD):
            alive = np.flatnonzero(state)
            place, state = place[alive], state[alive]
            over = self.said[state] > 0
            out.append(place[over])
            place, state = place[~over], state[~over]
            inside = place + d < len(x)
            place, state = place[inside], state[inside]
            state = self.step(state, x[place + d])
        return np.unique(np.concatenate([*out, place[state > 0]]))

    def run(self, x: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(first place, place behind, items) of every window in x, by its end."""
        done, size, edges, n = 0, self.size, self.edges, len(self.key)
        for begin in self.begins(x).tolist():
            if begin < done:
                continue
            state, done = 0, begin
            while done < len(x):
                word, done = int(x[done]), done + 1
                while True:
                    k = bisect.bisect_left(edges, state * size + word) if word else n
                    if k < n and edges[k] == state * size + word:
                        state = k + 1
                        break
                    if not state:
                        break
                    state = self.back[state] if word else 0
                if not state:
                    break
                end = self.told[state]
                while end:
                    a, z = np.searchsorted(self.last, [end, end + 1])
                    yield done - int(self.depth[end]), done, self.item[a:z].tolist()
                    end = self.told[self.back[end]]


def find_all(built: Automaton, texts: list[str | None]) -> list[tuple[int, list[list[int]], set]]:
    """For each text its number of words, merged [first, end) runs of hit words, and ids of the items that occur. Texts go through
    together, a place without a word after each."""
    parts, starts, at = [], [], 0
    for t in texts:
        x = built.numbers(words(t))
        parts += [x, np.zeros(1, np.int64)]
        starts.append(at)
        at += len(x) + 1
    out: list = [(len(x), [], set()) for x in parts[::2]]
    for a, z, items in built.run(np.concatenate(parts) if parts else np.zeros(0, np.int64)):
        k = bisect.bisect_right(starts, a) - 1
        out[k][1].append([a - starts[k], z - starts[k]])
        out[k][2].update(built.names[i] for i in items)
    return [(n, merge(runs), found) for n, runs, found in out]


def merge(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def char_spans(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of runs of words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat, bounds, at = raw.translate(FOLD), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    point = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(point(bounds[a][0]), point(bounds[b - 1][1])) for a, b in runs]


def _found(spark: SparkSession, docs: DataFrame, block: list, text: str, keep: list[str], only_hits: bool = False) -> DataFrame:
    """The columns `keep` of docs with those of SCHEMA: for each row, or for those with hits alone."""
    shipped, key = common.ship(spark, block), uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        built = common.once(key, lambda: Automaton(shipped.value))
        found = find_all(built, b.column(text).to_pylist())
        more = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x for x in f[2] if x is not None) for f in found], pa.list_(pa.string()))]
        out = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *more], names=[*keep, "n_words", "hits", "items"])
        return out.filter(pa.array([bool(f[1]) for f in found], pa.bool_())) if only_hits else out

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return common.arrow_map(docs.select(*dict.fromkeys([*keep, text])), run, f"{kept}, {SCHEMA}")


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hits (runs of hit words) and items (ids, sorted as strings). Columns of these names in docs are replaced.

    The benchmark comes to the driver a block at a time. With one block (the usual case) the scan is one narrow pass. With several, each
    is a pass that reads the texts and writes hits alone; texts with hits, by a hash of 128 bits, then meet the documents once.
    """
    docs = docs.drop("n_words", "hits", "items")
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator(prefetchPartitions=False)
    each = blocks(((r[0], r[1]) for r in rows), block_bytes)
    first, second = next(each, []), next(each, None)
    if second is None:
        return _found(spark, docs, first, text, docs.columns)
    hashed = docs.select(F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), text)
    parts = [common.materialize(spark, _found(spark, hashed, b, text, ["_a", "_b"], True)) for b in (first, second, *each)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    found = both.groupBy("_a", "_b").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("i"))
    found = common.materialize(spark, found)
    n, parts = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("h") + F.size("i")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and parts <= BROADCAST_PARTS:
        met = docs.join(F.broadcast(found), (F.xxhash64(text) == F.col("_a")) & (F.xxhash64(F.lit(1), text) == F.col("_b")), "left")
    else:
        # A text that a third of all documents share is met by several tasks.
        salts = 16
        dealt = docs.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).withColumns({"_x": F.xxhash64(text), "_y": F.xxhash64(F.lit(1), text)})
        salted = found.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = dealt.join(salted, (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")) & (F.col("_s") == F.col("_t")), "left").drop("_s", "_t", "_x", "_y")
    # Runs of several blocks may touch: merged in order, as merge() does.
    run = lambda a, b: F.array(a, b)
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, r: F.when((F.size(acc) > 0) & (r[0] <= F.get(F.get(acc, F.size(acc) - 1), F.lit(1))), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(run(last(acc)[0], F.greatest(last(acc)[1], r[1]))))).otherwise(F.array_append(acc, r))
    merged = F.aggregate(F.array_sort("h"), F.array().cast("array<array<int>>"), join)
    none = F.array().cast("array<array<int>>"), F.array().cast("array<string>")
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    return met.withColumns({"n_words": n_words, "hits": F.coalesce(merged, none[0]), "items": F.coalesce("i", none[1])}).drop("_a", "_b", "h", "i")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, without the documents in which a benchmark window occurs."""
    plain = common.numbered(docs)
    return scan(spark, plain, benchmark, plain.columns[docs.columns.index(text)]).where(F.size("hits") == 0).select(*plain.columns).toDF(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(spark, docs, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, r: s + (r[1] - r[0]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
