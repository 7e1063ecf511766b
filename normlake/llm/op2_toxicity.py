"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nystroem landmarks.

The kernel <v, w> of two words sums, over all sequences of three characters that both hold in order within SPAN places, LAMBDA to the number
of places skipped in each: gaps and inserted characters cost weight but break nothing. Words have k(v, w) = (<v, w> / (<v, v> <w, w>) ** BARE)
** SHARP, and texts K(X, Y) = (|X| |Y|) ** -LONG times the sum of k over all pairs of their words: scaled powers and sums of a kernel are
kernels. Nystroem's map of a text is its vector of K with the landmarks, each taken as a text of one word, times the inverse root of the
landmarks' own kernel matrix. Landmarks are character runs that differ most between labelled toxic and other texts, and some plain words. A
squared-hinge support vector machine is trained on the map in the primal, and a sigmoid turns its margin into a score.

Words are lower-cased and lose all but letters (digits and signs that stand for letters are read as those); SPELLED single letters or more in a
row are also read as one word, wherever in the text.

The fit takes at most `most` labelled documents of at most `chars` characters, chosen by hash: a bounded sample; scoring takes whole texts.

Defined results: null or empty text is scored as a text without words; with no labels, or labels of one kind, every score is that kind's
(0 if there is none); rows with a null id teach nothing; repeated rows are scored each; of repeated labels and of repeated rows one teaches. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import common

MOST, CHARS = 6000, 20_000
LANDMARKS, PLAIN = 64, 12
LAMBDA, SPAN = 0.8, 6
RIDGE = 1e-6
#: Weight in the fit of texts with gaps put in.
GAPPED = 0.5
#: Exponents of the kernel: of a word's own length, of the words' kernel, of a text's number of words.
BARE, SHARP, LONG = 0.2, 4, 0.7
#: Least eigenvalue of the landmarks' matrix that is taken as it is.
LEAST = 0.05
#: Words that a worker keeps at most; then it starts anew.
CACHE = 120_000
SPELLED = 3
HASH_BITS = 22
_PAIRS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
_READ = str.maketrans("013457@$", "oieastas")
_FACTORS = [np.uint32(pow(2654435769, 2 * k + 1, 1 << 32)) for k in range(3)]


def plain(token: str) -> str:
    """The letters of a token, lower-cased."""
    t = token.lower()
    if not t.isalpha():
        if any(map(str.isalpha, t)):
            t = t.translate(_READ)
        t = "".join(filter(str.isalpha, t))
    return t


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, sequence as a hash, weight) of all sequences of three characters of `^word` within SPAN places; one that comes twice is there twice."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    c = np.frombuffer(("".join(f"^{w} " for w in words) + " " * SPAN).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    n = len(owner)
    blank = c == 32
    ends = np.where(blank, np.arange(len(c)), len(c))
    end = np.minimum.accumulate(ends[::-1])[::-1]
    room = (end - np.arange(len(c)))[:n]
    who, what, weight = [], [], []
    for a, b in _PAIRS:
        at = np.flatnonzero(room > b)
        h = (c[at] * _FACTORS[0] + c[at + a] * _FACTORS[1] + c[at + b] * _FACTORS[2]) >> np.uint32(32 - HASH_BITS)
        who.append(owner[at])
        what.append(h)
        weight.append(np.full(len(at), LAMBDA ** (b - 2), np.float32))
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


def own(who: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """<w, w> of n words by their subsequences(): the squares of weights, added up over a sequence's occurrences first."""
    key = who << HASH_BITS | what
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    total = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
    return np.maximum(np.bincount(key[order[first]] >> HASH_BITS, total * total, minlength=n), 1e-9)


class Kernel:
    """k of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, m = landmarks, len(landmarks)
        marked = [k for k, x in enumerate(landmarks) if x.startswith("^")]
        who, what, weight = subsequences([landmarks[k].lstrip("^") for k in marked])
        # A landmark from inside of words has no sequence with the mark of a word's beginning.
        inside = [k for k, x in enumerate(landmarks) if not x.startswith("^")]
        who2, what2, weight2 = _unmarked([landmarks[k] for k in inside])
        who = np.concatenate([np.array(marked, np.int64)[who], np.array(inside, np.int64)[who2]])
        what, weight = np.concatenate([what, what2]), np.concatenate([weight, weight2])
        seqs, rows = np.unique(what, return_inverse=True)
        table = np.zeros((len(seqs), m))
        np.add.at(table, (rows, who), weight)
        self.norm = np.maximum((table**2).sum(0), 1e-9) ** BARE
        self.gram = (table.T @ table / (self.norm[:, None] * self.norm)) ** SHARP
        # Landmarks of each sequence, one sequence after the other: few have more than one.
        at, self.column = np.nonzero(table)
        self.value = (table / self.norm)[at, self.column]
        self.first = np.searchsorted(at, np.arange(len(seqs) + 1))
        self.row = np.full(1 << HASH_BITS, -1, np.int32)
        self.row[seqs] = np.arange(len(seqs))
        self.known: dict[str, int] = {}
        self.rows, self.single = np.zeros((CACHE, m), np.float32), np.zeros(CACHE, bool)

    def of(self, words: list[str]) -> np.ndarray:
        m = len(self.landmarks)
        out = np.zeros((len(words), m), np.float32)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            who, what, weight = subsequences(part)
            row = self.row[what]
            hit = np.flatnonzero(row >= 0)
            row, n = row[hit], self.first[row[hit] + 1] - self.first[row[hit]]
            each = np.repeat(np.arange(len(hit)), n)
            of = np.arange(len(each)) + np.repeat(self.first[row] - np.cumsum(n) + n, n)
            dot = np.bincount(who[hit[each]] * m + self.column[of], weight[hit[each]] * self.value[of], minlength=len(part) * m).reshape(-1, m)
            # Only words with a common sequence need their own norm.
            some = dot.any(1)
            if some.any():
                its = np.flatnonzero(some[who])
                norm = own(who[its], what[its], weight[its], len(part))[some] ** BARE
                out[at : at + len(part)][some] = (dot[some] / norm[:, None]) ** SHARP
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if new:
            if len(known) + len(new) > len(self.rows):
                known.clear()
                new = list(dict.fromkeys(tokens))
            if len(new) > len(self.rows):
                self.rows, self.single = np.zeros((len(new), len(self.landmarks)), np.float32), np.zeros(len(new), bool)
            read, at = [plain(t) for t in new], len(known)
            self.rows[at : at + len(new)] = self.of(read)
            self.single[at : at + len(new)] = [len(r) == 1 for r in read]
            known.update(zip(new, range(at, at + len(new))))
        return [known[t] for t in tokens]

    def learn(self, texts: list[str | None]) -> None:
        """Have the words of many texts ready: worked out together they cost less than text by text."""
        words: dict[str, None] = {}
        for t in texts:
            words.update(dict.fromkeys((t or "").split()))
            if len(words) > CACHE // 2:
                break
        self.ids(list(words))

    def text(self, text: str | None) -> np.ndarray:
        """K of a text with each landmark. Long texts are taken in parts, but single letters in a row over their whole length."""
        tokens = (text or "").split()
        total, single = np.zeros(len(self.landmarks)), np.zeros(len(tokens), bool)
        for at in range(0, len(tokens), 50_000):
            i = np.array(self.ids(tokens[at : at + 50_000]), np.int64)
            total += self.rows[i].sum(0)
            single[at : at + 50_000] = self.single[i]
        if single.sum() >= SPELLED:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
            spelled = ["".join(map(plain, tokens[a:z])) for a, z in zip(edge[::2], edge[1::2]) if z - a >= SPELLED]
            if spelled:
                total += self.of(spelled).sum(0)
        return total / max(1, len(tokens)) ** LONG


def _unmarked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """subsequences() without those that hold the mark of a word's beginning."""
    own, seq, weight = [], [], []
    for k, w in enumerate(words):
        for i in range(len(w)):
            for a, b in _PAIRS:
                if i + b < len(w):
                    c = np.array([ord(w[i]), ord(w[i + a]), ord(w[i + b])], np.uint32)
                    own.append(k)
                    seq.append(int((c[0:1] * _FACTORS[0] + c[1:2] * _FACTORS[1] + c[2:3] * _FACTORS[2])[0] >> np.uint32(32 - HASH_BITS)))
                    weight.append(LAMBDA ** (b - 2))
    return np.array(own, np.int64), np.array(seq, np.int64), np.array(weight, np.float32)


def choose(rows: list[tuple[str, int]], n: int = LANDMARKS, n_plain: int = PLAIN) -> list[str]:
    """Character runs (4 to 8, `^` before a word's first) whose words per document differ most surely, none much like another; then frequent words."""
    words = [({plain(t) for t in text.split()}, y) for text, y in rows]
    toxic, clean = [w for w, y in words if y], [w for w, y in words if not y]

    def runs(ws: set, k: int, only: set | None = None) -> list:
        return [g for w in ws for g in {f"^{w}"[i : i + k] for i in range(len(w) + 2 - k)} if len(g.lstrip("^")) >= 4 and (only is None or g in only)]

    def spread(docs: list[set], k: int, only: set | None = None) -> tuple[Counter, Counter]:
        """Sums over documents of the number of words that hold a run, 4 at most, and of its square."""
        one, two = Counter(), Counter()
        for ws in docs:
            for g, c in Counter(runs(ws, k, only)).items():
                one[g] += min(c, 4)
                two[g] += min(c, 4) ** 2
        return one, two

    found, nt, nc = [], len(toxic), max(1, len(clean))
    for k in range(4, 9):
        often = {g for g, c in Counter(g for ws in toxic for g in set(runs(ws, k))).items() if c >= max(3, 0.01 * nt)}
        (yes, yes2), (no, no2) = spread(toxic, k, often), spread(clean, k, often)
        for g in often:
            p, q = yes[g] / nt, no[g] / nc
            noise = (max(yes2[g] / nt - p * p, 0.01) / nt + max(no2[g] / nc - q * q, 0.01) / nc) ** 0.5
            found.append(((p - q) / noise + 0.01 * k, g))
    chosen: list[str] = []
    for z, g in sorted(found, reverse=True):
        bare = g.lstrip("^")
        if z < 3 or len(chosen) == n - n_plain:
            break
        # Not a piece of, or around, one that is there.
        if not any(bare[i : i + 4] in c for c in chosen for i in range(len(bare) - 3)):
            chosen.append(g)
    common_words = Counter(w for ws in clean for w in ws if len(w) >= 5)
    return chosen + [f"^{w}" for w, _ in sorted(common_words.items(), key=lambda x: (-x[1], x[0]))[:n_plain]]


class Model:
    """direct: one weight for each landmark, as the Nystroem map and the machine's weights are both linear in the text's K."""

    def __init__(self, landmarks: list[str], direct: np.ndarray, bias: float, sigmoid: tuple[float, float], constant: float | None = None):
        self.constant = constant
        if constant is None:
            self.kernel, self.direct, self.bias, self.sigmoid = Kernel(landmarks), direct, bias, sigmoid

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        margin = float(self.kernel.text(text) @ self.direct + self.bias)
        a, b = self.sigmoid
        return float(1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40))))


def gapped(word: str) -> str:
    """The word with an x in its middle."""
    return f"{word[: len(word) // 2]}x{word[len(word) // 2 :]}"


def train(rows: list[tuple[str, int]]) -> tuple:
    """Arguments of Model. rows: text, 0 or 1."""
    y = np.array([1.0 if t else -1.0 for _, t in rows])
    if not len(rows) or abs(y.sum()) == len(rows):
        return [], np.zeros(0), 0.0, (0.0, 0.0), float(len(rows) > 0 and y[0] > 0)
    landmarks = choose(rows)
    kernel = Kernel(landmarks)
    kernel.learn([t for t, _ in rows])
    # Toxic texts, and as many others, once more with a letter put into every word: what a gap costs is learned too, and that gaps alone mean nothing.
    n, toxic = len(rows), [t for t, v in rows if v]
    more = [(t, 1) for t in toxic] + [(t, 0) for t, v in rows if not v][: len(toxic)]
    rows = rows + [(" ".join(gapped(w) for w in t.split()), v) for t, v in more]
    kernel.learn([t for t, _ in rows[n:]])
    y = np.array([1.0 if t else -1.0 for _, t in rows])
    x = np.array([kernel.text(t) for t, _ in rows], float)
    value, vector = np.linalg.eigh(kernel.gram)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, LEAST))) @ vector.T
    x = x @ whiten
    scale = max(1e-9, float(np.sqrt((x[:n] ** 2).sum(1).mean())))
    x = np.column_stack([x / scale, np.ones(len(x))])
    share = (y[:n] > 0).mean()
    weight = np.where(y > 0, min(4.0, (1 - share) / share) ** 0.5, 1.0)
    weight[n:] = GAPPED
    w, ridge = np.zeros(x.shape[1]), RIDGE * len(x) * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + ridge, xa.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    # Platt's sigmoid, by Newton's method, on the same rows: between the other texts and the toxic ones with gaps.
    z, t, count = x @ w, (y > 0).astype(float), np.where(np.arange(len(y)) < n, 1.0, GAPPED)
    z1, ab = np.column_stack([z, np.ones(len(z))]), np.array([2.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z1 @ ab, -30, 30)))
        ab = ab - np.linalg.solve((z1 * (count * p * (1 - p))[:, None]).T @ z1 + 1e-2 * np.eye(2), z1.T @ (count * (p - t)) + 1e-2 * (ab - [2.0, 0.0]))
    return landmarks, whiten @ w[:-1] / scale, float(w[-1]), (float(ab[0]), float(ab[1])), None


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, chars: int = CHARS) -> tuple:
    """From a bounded sample of the labelled documents that aren't held out and have at most `chars` characters."""
    rated = labels.where(common.learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    picked = common.sample_of(rated, ["_id", "_toxic"], most)
    # At most `most` ids: bounded, so that no text has to move. Rows that repeat a text teach once.
    met = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where(F.length("text") <= chars).select(F.col("_id").cast("string").alias("k"), F.col("text").alias("t"), F.col("_toxic").alias("y"))
    got = common.sample_of(common.materialize(docs.sparkSession, met), ["k", "t", "y"], most).toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("k", "t", "y"))))
    del got
    model = train([(t, y) for _, t, y in rows])
    del rows
    common.trim()
    return model


def rate(spark: SparkSession, docs: DataFrame, model: tuple, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score for each row of docs."""
    shipped, name = common.ship(spark, model), uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = common.once(name, lambda: Model(*shipped.value)), b.column(1).to_pylist()
        if m.constant is None:
            m.kernel.learn(texts)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in texts], pa.float64())], names=[key, "score"])

    return common.arrow_map(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = rate(spark, docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
