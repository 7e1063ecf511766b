"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are words between blanks, lower-cased, each with a mark before and after; features are their character n-grams (1 to 3), hashed,
weighted by count x inverse document frequency and divided by the number of n-grams. Weights are learned online with FTRL-proximal
updates under an elastic net (most stay zero), then a temperature is fitted on rows set apart.

The fit takes at most `most` labelled documents of at most `chars` characters, chosen by hash: a bounded sample; scoring takes whole texts.

Defined results: null text, empty text or text without a letter gives `und` and score 0; with nothing to learn from, every text is `und`;
rows with a null id or null lang teach nothing; repeated rows are scored each, and of rows that share id and lang the least text teaches; a tie goes to the language first in order. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import common

BITS = 15
#: Bound of the training sample: documents, and characters in a document.
MOST, CHARS = 4000, 4000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.02, 0.02
#: Characters that are hashed at once.
PIECE = 1 << 18
#: Odd factors of the multiplicative hash, by rule: powers of a number near 2 ** 32 / golden ratio.
MULTIPLIERS = [np.uint32(pow(2654435769, 2 * k + 1, 1 << 32)) for k in range(6)]
UND = "und"


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, in pieces of bounded size; n-grams don't reach over a blank."""
    s = f" {' '.join(text.lower().split())} "
    for at in range(0, max(1, len(s) - 1), PIECE):
        part = s[at : at + PIECE + 2]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        one, two, three = c[:PIECE] * MULTIPLIERS[0], c[:-1][:PIECE] * MULTIPLIERS[1] + c[1:][:PIECE] * MULTIPLIERS[2], c[:-2] * MULTIPLIERS[3] + c[1:-1] * MULTIPLIERS[4] + c[2:] * MULTIPLIERS[5]
        yield np.concatenate([one[c[:PIECE] != 32], two, three[c[1:-1] != 32]]) >> np.uint32(32 - BITS)


class Model:
    """langs; weights[bucket, lang] with the IDF in them; bias; temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in buckets(text):
            total += self.weights[g].sum(0) if len(g) < 1 << BITS else np.bincount(g, minlength=1 << BITS) @ self.weights
            n += len(g)
        return self.bias + total / max(1, n) * SCALE

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UND, 0.0
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k])


#: Scale of the averaged features, so that weights are of order one.
SCALE = 30.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = sum(np.bincount(g, minlength=1 << BITS) for g in buckets(text))
    i = np.flatnonzero(counts)
    return i, counts[i] / max(1, counts.sum())


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """rows: text, lang."""
    langs = sorted({lang for _, lang in rows})
    data = [(*vector(t), langs.index(lang)) for t, lang in rows if t.split()]
    size, n = 1 << BITS, len(data)
    if not data or len(langs) < 1:
        return Model([], np.zeros((size, 0)), np.zeros(0), 1.0)
    df = np.zeros(size)
    for i, _, _ in data:
        df[i] += 1
    idf = np.log((1 + n) / (1 + df)) + 1
    z, s, m = np.zeros((size, len(langs))), np.zeros((size, len(langs))), len(langs)
    zb, sb, bias = np.zeros(m), np.zeros(m), np.zeros(m)

    def weights(zi: np.ndarray, si: np.ndarray, l1: float = L1, l2: float = L2) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(si)) / ALPHA + l2))

    order, apart = np.random.default_rng(seed), max(1, n // 10) if n >= 20 else 0
    for _ in range(EPOCHS):
        for r in order.permutation(np.arange(apart, n)):
            i, x, y = data[r]
            x = (x * idf[i] * SCALE)[:, None]
            w, bias = weights(z[i], s[i]), weights(zb, sb, 0.0)
            p = softmax((bias + (w * x).sum(0))[None])[0]
            p[y] -= 1
            g = x * p
            z[i] += g - (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / ALPHA * w
            s[i] += g * g
            zb += p - (np.sqrt(sb + p * p) - np.sqrt(sb)) / ALPHA * bias
            sb += p * p
    model = Model(langs, (weights(z, s) * idf[:, None]), weights(zb, sb, 0.0), 1.0)
    if apart:
        logits = np.array([model.bias + (x[:, None] * model.weights[i] * SCALE).sum(0) for i, x, _ in data[:apart]])
        y = np.array([d[2] for d in data[:apart]])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(apart), y] + 1e-12).mean()
        model.temperature = min(np.geomspace(0.2, 5, 60).tolist(), key=loss)
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = MOST, chars: int = CHARS) -> Model:
    """The model from a bounded sample of the labelled rows that aren't held out; a sampled text is given by at most `chars` characters from its middle on."""
    # Where the sample of a long text begins is its middle.
    start = F.greatest(F.lit(1), ((F.length(text) - chars) / 2).cast("int") + 1)
    usable = docs.where(common.learnable(F.col(key)) & F.col(lang).isNotNull())
    named = usable.select(F.col(key).cast("string").alias("k"), F.substring(F.col(text), start, F.lit(chars)).alias("t"), F.col(lang).alias("l"))
    got = common.sample_of(named, ["k", "l"], most).where("t IS NOT NULL").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("k", "t", "l"))), key=lambda r: (zlib.crc32(r[0].encode()), r))
    del got
    model = train([(t, lang) for _, t, lang in rows])
    del rows
    common.trim()
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for each row of docs."""
    shipped, name = common.ship(spark, (model.langs, model.weights, model.bias, model.temperature)), uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = common.once(name, lambda: Model(*shipped.value))
        found = [m.predict(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[key, "lang_pred", "score"])

    return common.arrow_map(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(spark, docs, fit(docs))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
