"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > j) = sigmoid(score - threshold_j): one weight for each hashed token feature, shared by all grades, and ordered thresholds. Tokens
are words between blanks, told as a shape (letters as a or A, digits as 9, runs of three or more as one, other characters as they are), as a
shape pair with the token before, as "same as before" for a repeated token, and as the word itself. Features are shares of a text's tokens.
Expected grade and the probability of a grade above the lowest come out; selection goes by that probability. In the fit all grades weigh the
same in sum, so both are what they would be if all grades were equally frequent, not as frequent as among the ratings.

The fit takes at most `most` rated documents of at most `chars` characters, chosen by hash: a bounded sample; scoring takes whole texts.

Defined results: null or empty text is scored with no features; with no ratings or one grade only, every row gets that grade (0, if there is
none) and is kept; rows with a null id teach nothing; repeated rows are scored each; of repeated ratings and of repeated rows one teaches. Extra columns are
ignored by `grade` and kept by `select_good`.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import common

BITS = 14
MOST, CHARS = 4000, 20_000
CACHE = 200_000
#: A document is kept if P(grade above the lowest) is at least this.
KEEP = 0.5
RIDGE, STEPS, RATE = 3e-4, 400, 0.15
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")


def shape(token: str) -> str:
    return _LOWER.sub("a", _UPPER.sub("A", _DIGIT.sub("9", token)))[:24]


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Tokens:
    """What features() needs of a token, by number: buckets of its shape and of itself, and a number for its shape. CACHE tokens at most, or one text's."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, 3), np.int64)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(tokens) if t not in self.number]
        if len(self.number) + len(new) > CACHE:
            self.number.clear()
            new = list(dict.fromkeys(tokens))
        at = len(self.number)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:at], np.zeros((max(at, len(new)) + len(new), 3), np.int64)])
        for k, t in enumerate(new, at):
            s = shape(t)
            self.number[t] = k
            self.table[k] = bucket("s", s), bucket("w", t), zlib.crc32(s.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


def features(text: str | None, known: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the share of each: up to four features for every token."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    n = known.numbers(tokens)
    k = known.table[n]
    pair = (k[1:, 2] * 31 + k[:-1, 2] * 17 + 5) & ((1 << BITS) - 1)
    same = int((n[1:] == n[:-1]).sum())
    all_ = np.concatenate([k[:, 0], k[:, 1], pair, np.full(3 * same, bucket("r", ""), np.int64)])
    # A short text has few buckets: they are sorted, not counted over the whole width.
    if len(all_) < 1 << BITS:
        i, seen = np.unique(all_, return_counts=True)
    else:
        seen = np.bincount(all_, minlength=1 << BITS)
        i = np.flatnonzero(seen)
        seen = seen[i]
    return i, np.sqrt(seen / len(tokens))


class Model:
    """grades, weights, thresholds (ordered)."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds, self.cache = grades, weights, thresholds, Tokens()

    def rate(self, text: str | None) -> tuple[float, float]:
        """Expected grade; probability of more than the lowest."""
        if len(self.grades) < 2:
            return float(self.grades[0] if self.grades else 0), 1.0
        i, x = features(text, self.cache)
        above = 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[i] @ x, -50, 50)))
        return float(self.grades[0] + (np.diff(self.grades) * above).sum()), float(above[0])


def train(rows: list[tuple[str, int]]) -> Model:
    """rows: text, grade. Full-batch Adam on the likelihood with classes weighing the same in sum; thresholds are kept in order by their gaps' logarithms."""
    grades = sorted({g for _, g in rows})
    if len(grades) < 2:
        return Model(grades, np.zeros(1 << BITS), np.zeros(0))
    cache = Tokens()
    data = [(i.astype(np.int32), x.astype(np.float32)) for i, x in (features(t, cache) for t, _ in rows)]
    y = np.array([grades.index(g) for _, g in rows])
    del cache
    at = np.repeat(np.arange(len(data), dtype=np.int32), [len(i) for i, _ in data])
    col, val = np.concatenate([i for i, _ in data]), np.concatenate([x for _, x in data])
    del data
    used = np.flatnonzero(np.bincount(col, minlength=1 << BITS))
    col = np.searchsorted(used, col).astype(np.int32)
    share = np.bincount(y, minlength=len(grades))
    weight = (len(y) / (len(grades) * share))[y]
    k = len(grades) - 1
    w, first, gaps = np.zeros(len(used)), 0.0, np.zeros(k - 1)
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    for step in range(1, STEPS + 1):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(at, val * w[col], minlength=len(y))
        # P(grade = j) = S(score - cut[j-1]) - S(score - cut[j]), with S = 1 below the first cut and 0 above the last.
        s = 1 / (1 + np.exp(np.clip(cuts[None] - score[:, None], -40, 40)))
        hi, lo = np.column_stack([np.ones(len(y)), s])[np.arange(len(y)), y], np.column_stack([s, np.zeros(len(y))])[np.arange(len(y)), y]
        p = np.maximum(hi - lo, 1e-9)
        d = s * (1 - s)
        dhi, dlo = np.column_stack([np.zeros(len(y)), d])[np.arange(len(y)), y], np.column_stack([d, np.zeros(len(y))])[np.arange(len(y)), y]
        g_score = -weight * (dhi - dlo) / p / len(y)
        g_cut = np.array([(weight / p / len(y) * ((y == j + 1) * d[:, j] - (y == j) * d[:, j])).sum() for j in range(k)])
        g_w = np.bincount(col, val * g_score[at], minlength=len(w)) + RIDGE * w
        g = np.concatenate([g_w, [g_cut.sum()], [np.exp(gaps[j]) * g_cut[j + 1 :].sum() for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[: len(w)], first - move[len(w)], gaps - move[len(w) + 1 :]
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(grades, weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, chars: int = CHARS, rating: str = "quality") -> Model:
    """From a bounded sample of the rated documents that aren't held out and have at most `chars` characters."""
    rated = labels.where(common.learnable(F.col("doc_id")) & F.col(rating).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(rating).cast("int").alias("_grade"))
    picked = common.sample_of(rated, ["_id", "_grade"], most)
    # At most `most` ids: bounded, so that no text has to move. Rows that repeat a text teach once.
    met = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where(F.length("text") <= chars).select(F.col("_id").cast("string").alias("k"), F.col("text").alias("t"), F.col("_grade").alias("g"))
    got = common.sample_of(common.materialize(docs.sparkSession, met), ["k", "t", "g"], most).toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("k", "t", "g"))))
    del got
    model = train([(t, g) for _, t, g in rows])
    del rows
    common.trim()
    return model


def grade(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, expected_grade, p_above and kept, for each row."""
    shipped, name = common.ship(spark, (model.grades, model.weights, model.thresholds)), uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = common.once(name, lambda: Model(*shipped.value))
        found = [m.rate(t) for t in b.column(text).to_pylist()]
        more = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[1] >= KEEP for f in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *more], names=[*keep, "expected_grade", "p_above", "kept"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return common.arrow_map(docs.select(*dict.fromkeys([*keep, text])), run, f"{kept}, expected_grade double, p_above double, kept boolean")


def select_good(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the documents that the model rejects. Columns called like the results keep their own values."""
    names = docs.columns
    plain = common.numbered(docs)
    text = plain.columns[names.index("text")]
    return grade(spark, plain, model, plain.columns, text).where("kept").select(*plain.columns).toDF(*names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = grade(spark, docs, fit(docs, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_above", "kept")
