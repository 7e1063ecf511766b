"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles. Two fingerprints link at 3 or fewer differing bits, so that one
of the two 32-bit halves differs in at most one bit. A half is a 23-bit segment and 9 further bits. If the one error lies in the 9
bits, the segments are equal: the segment itself is a key. Otherwise the 9 bits are equal and the segments differ in at most one bit:
the perfect binary Golay code (23, 12, 7) puts each segment within 3 bits of one codeword; two segments at distance 1 that decode to
different codewords are each at distance 3 from their own and at distance 4 from the other's. So the keys of a half are its codeword,
and, if that is 3 bits away, the five codewords 4 bits away, each with the 9 bits. The other half differs in at most three bits, so that
one of its four bytes is equal: each key is joined with each of them. Every link of 3 bits or fewer shares a key of 29 bits or more.

Within a key candidates are verified by Hamming distance: by a join where few share it; otherwise only a spanning forest of the links goes
on, never all pairs. Keys with more than BUCKET fingerprints are cut into blocks, any two of which meet in a task: exact, without a cap.

Defined results: null or empty text has fingerprint zero and links like any other; equal texts share a fingerprint and a component;
rows with a null doc_id get a fingerprint and the smallest non-null doc_id reachable (null if there is none); repeated rows come out
as often as they came in; extra columns are ignored by `near_duplicates` and kept by `dedup`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from normlake import session
from normlake.llm import common
from normlake.llm.op10_decontaminate import FOLD
from normlake.session import ensure_code

SEED = 42
MAX_BITS = 3
#: The bits of a key that tell what it is.
LOW = 63
#: Fingerprints of one key that meet in one task; larger keys are cut into blocks, exactly.
BUCKET = 8192
#: Keys with at most so many are verified by a join; larger ones give a spanning forest instead of pairs.
SMALL = 32
#: Fingerprints of a document when near copies are sought.
PRINTS = 6
#: Words of a shingle, and the share of common shingles from which two texts are near copies.
WIDTH, ALIKE = 5, 0.8
#: Distinct texts that meet in one task to be held against each other; larger components are cut into blocks, exactly.
TEXTS = 256
#: Generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    h, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((h(join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)))), np.uint64, len(w) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << i for i, n in enumerate(ones.tolist()) if 2 * n > len(hashes)))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome (11 bits): the error pattern of least weight; the five patterns of weight 4, or zeros unless that weight is 3."""
    syndrome = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        syndrome[i] = r
    least, four, filled = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64), np.zeros(2048, np.int64)
    weight3 = np.zeros(2048, bool)
    for n in range(4):
        for bits in itertools.combinations(range(23), n):
            s = 0
            for b in bits:
                s ^= int(syndrome[b])
            least[s], weight3[s] = sum(1 << b for b in bits), n == 3
    for bits in itertools.combinations(range(23), 4):
        s = int(syndrome[bits[0]] ^ syndrome[bits[1]] ^ syndrome[bits[2]] ^ syndrome[bits[3]])
        if weight3[s]:
            four[s, filled[s]] = sum(1 << b for b in bits)
            filled[s] += 1
    return least, four


def _syndromes(x: np.ndarray) -> np.ndarray:
    r = x.copy()
    for k in range(22, 10, -1):
        r ^= np.where(r >> k & 1, GENERATOR << (k - 11), 0)
    return r


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints. A key holds the half, the kind, the 9 bits and the codeword, or the segment."""
    least, four = common.once("golay", _tables)
    rows, out = [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        v = (fp >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF
        seg, rest, top = v & 0x7FFFFF, v >> 23, half << 60
        s = _syndromes(seg)
        rows += [every, every]
        out += [top | 1 << 59 | seg, top | rest << 23 | (seg ^ least[s])]
        for k in range(5):
            e = four[s, k]
            rows.append(every[e > 0])
            out.append((top | rest << 23 | (seg ^ e))[e > 0])
    return np.concatenate(rows), np.concatenate(out)


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) of the components that links of MAX_BITS or fewer form among fp, a row at a time: no pairs are kept."""
    n = len(fp)
    root, done = np.full(n, -1), np.zeros(n, bool)
    for start in range(n):
        if done[start]:
            continue
        todo, done[start] = [start], True
        while todo and not done.all():
            open_ = np.flatnonzero(~done)
            near = open_[np.bitwise_count(fp[open_] ^ fp[todo.pop()]) <= MAX_BITS]
            done[near], root[near] = True, start
            todo += near.tolist()
    has = root >= 0
    return fp[has], fp[root[has]]


def _fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[key, "fp"])

    return common.arrow_map(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


def _joined(key: np.ndarray, low: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with each byte of the half that it doesn't hold, mixed into one number; its lowest bits are `low` and which byte it is.
    A clash of mixed keys only adds candidates. Returns rows and keys."""
    other = np.where(low & 1, fp & 0xFFFFFFFF, fp >> 32 & 0xFFFFFFFF)
    out = []
    for k in range(4):
        g = (key.view(np.uint64) ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        g = ((g ^ (g >> np.uint64(29))) + (other >> 8 * k & 255).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((g ^ (g >> np.uint64(32))).view(np.int64) & ~LOW | low | k << 1)
    return np.tile(np.arange(len(fp)), 4), np.concatenate(out)


def _links(spark: SparkSession, fps: DataFrame, bucket: int = BUCKET, small: int = SMALL) -> DataFrame:
    """fps: r (0 to 7), fp, distinct. Links r, a, b between fingerprints of the same r; their components are those of all links of MAX_BITS or fewer.

    The lowest bits of a key hold the half, the byte and r, so that only these can meet, and rows need no columns for them.
    """

    def keyed(batches):
        for b in batches:
            r, fp = b.column("r").to_numpy().astype(np.int64), b.column("fp").to_numpy()
            rows, key = keys(fp.view(np.uint64))
            again, key = _joined(key, key >> 60 & 1 | r[rows] << 3, fp[rows])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[rows][again], pa.int64())], names=["key", "fp"])

    def linked(t: pa.Table) -> pa.Table:
        a, b = forest(t.column("fp").to_numpy().view(np.uint64))
        r = t.column("key")[0].as_py() >> 3 & 7
        return pa.table({"r": pa.array(np.full(len(a), r), pa.int32()), "a": a.view(np.int64), "b": b.view(np.int64)})

    ensure_code(spark)
    of = F.shiftright("key", 3).bitwiseAND(7).cast("int").alias("r")
    all_keys = fps.select("r", "fp").mapInArrow(keyed, "key bigint, fp bigint")
    shared = common.materialize(spark, all_keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"))
    few, many = shared.where(F.col("n") <= small), shared.where(F.col("n") > small)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select(of, "a", "b")
    # One block for most keys. A key of more than `bucket` fingerprints is cut into blocks, of which any two meet in a task of their own.
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    own = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return near.unionAll(met.groupBy("key", "lo", "hi").applyInArrow(linked, "r int, a bigint, b bigint")).distinct()


def components(spark: SparkSession, links: DataFrame, salts: int = 8) -> DataFrame:
    """(node, root) of every node of the links a, b; root is the least node of the component. Large-star and small-star in turn, until
    nothing changes; a hub's links are dealt over `salts` tasks. Links of a node with itself are of no use and are dropped."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """edges u > v. Large: all larger neighbours of a node go to its least neighbour; small: all smaller ones and the node itself."""
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        tied = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"])
        if large:
            out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.where("salt = 0").select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    edges = common.materialize(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    was = mark(edges)
    while True:
        old, edges = edges, common.materialize(spark, star(star(edges, True), False))
        now = mark(edges)
        session.drop(old)
        if now == was:
            break
        was = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def _component_ids(classes: DataFrame, roots: DataFrame, node: str, salts: int = 8) -> DataFrame:
    """node, component_id for each of the classes (node, least). A class without links is its own component and moves no further; the
    members of the others meet their component's least key in several tasks."""
    rooted = classes.select(node, "least").join(roots.withColumnRenamed("node", node), node, "left")
    linked = rooted.where(F.col("root").isNotNull()).withColumn("salt", F.pmod(F.xxhash64(node), F.lit(salts)).cast("int"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return linked.join(ids, ["root", "salt"]).select(node, "component_id").unionAll(rooted.where(F.col("root").isNull()).select(node, "least"))


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, fp bigint, component_id (least key reachable)."""
    fps = common.materialize(spark, _fingerprints(docs, key, text))
    least = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(spark, _links(spark, least.select(F.lit(0).alias("r"), "fp")).drop("r"))
    of = common.materialize(spark, _component_ids(least, roots, "fp"))
    return fps.join(of, "fp").select(key, "fp", "component_id")


def wide_prints(text: str | None, n: int = PRINTS) -> list[int]:
    """n fingerprints over the words (of letters and digits) of five bytes or more, or all words if there is none, each by hashes of its own."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    w = [x for x in w if len(x) >= 5] or w
    h = np.fromiter(map(_hash, w), np.uint64, len(w))
    out = []
    for r in range(n):
        g = (h ^ np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(g ^ (g >> np.uint64(29))))
    return out


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of every five consecutive words (of letters and digits), or of all words of a shorter text; a text without words is one word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = raw.translate(FOLD).split() or [raw.strip()]
    runs = zip(*(w[i:] for i in range(WIDTH))) if len(w) > WIDTH else [w]
    return np.unique(np.array([_hash(b" ".join(x)) for x in runs], np.uint64))


def alike(sets: list[np.ndarray], least: float = ALIKE) -> tuple[np.ndarray, np.ndarray]:
    """Links (set, root) of the components that pairs of a Jaccard similarity of `least` or more form, a set at a time: no pairs are kept."""
    n, size = len(sets), np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    # Sets that hold each value.
    holds, start_of = np.repeat(np.arange(n), size)[order], np.searchsorted(ids[order], np.arange(len(values) + 1))
    root, done, listed = np.full(n, -1), np.zeros(n, bool), n
    for start in range(n):
        if done[start]:
            continue
        todo, done[start] = [start], True
        while todo and not done.all():
            if 2 * (open_ := n - int(done.sum())) < listed:
                left = ~done[holds]
                holds, start_of, listed = holds[left], np.concatenate([[0], np.cumsum(left)])[start_of], open_
            k = todo.pop()
            own = ids[at[k] : at[k + 1]]
            many = start_of[own + 1] - start_of[own]
            common_ = np.bincount(holds[np.repeat(start_of[own] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)
            near = np.flatnonzero(~done & (common_ / (size + size[k] - common_) >= least))
            done[near], root[near] = True, start
            todo += near.tolist()
    has = np.flatnonzero(root >= 0)
    return has, root[has]


def _verified(spark: SparkSession, texts: DataFrame, docs: DataFrame, key: str, text: str, block: int, salts: int = 8) -> DataFrame:
    """texts: text_hash, least (key), proposed (component). Links a, b between text hashes whose components are those of all pairs of texts
    of the same proposed component that are alike. Any two blocks of a component meet in a task of their own: exact, without a cap."""

    def linked(t: pa.Table) -> pa.Table:
        name = t.column("text_hash").to_numpy()
        a, b = alike([shingles(x) for x in t.column("text").to_pylist()])
        return pa.table({"a": name[a], "b": name[b]})

    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("text_hash"), F.lit(salts)).cast("int"))
    sizes = texts.groupBy("proposed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = common.materialize(spark, dealt.join(sizes, ["proposed", "salt"]).select("text_hash", "least", "proposed", "n"))
    # One row has a text's least key, unless rows repeat: exact copies don't meet.
    rows = docs.select(F.xxhash64(text).alias("_hash"), F.col(key).alias("_key"), F.col(text).alias("text"))
    found = members.join(rows, (F.col("text_hash") == F.col("_hash")) & F.col("least").eqNullSafe(F.col("_key"))).select("text_hash", "proposed", "n", "text")
    own = found.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("proposed", "text_hash", "text", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return met.groupBy("proposed", "lo", "hi").applyInArrow(linked, "a bigint, b bigint")


def near_copies(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = PRINTS, block: int = TEXTS) -> DataFrame:
    """One row for each row of docs: key, text_hash, component_id. Texts are proposed if one of their n (eight at most) wide fingerprints
    differs in MAX_BITS or fewer: nearly all pairs whose five-word shingles are alike to 0.8 or more (measured in README), although a single
    fingerprint of them mostly differs in more bits than that. Of the distinct texts of a component of proposals, those link that are
    alike indeed, by their shingles; component_id is the least key of a component of such links."""
    cols = [f"f{r}" for r in range(n)]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([wide_prints(t, n) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, n).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(prints[:, r]) for r in range(n))], names=[key, "text_hash", *cols])

    kind = docs.schema[key].dataType.simpleString()
    prints = common.arrow_map(docs.select(key, text, F.xxhash64(text).alias("text_hash")), run, f"`{key}` {kind}, text_hash bigint, {', '.join(f'{c} bigint' for c in cols)}")
    prints = common.materialize(spark, prints.withColumn("node", F.xxhash64(*cols)))
    classes = common.materialize(spark, prints.groupBy("node").agg(*(F.any_value(c).alias(c) for c in cols)))
    each = classes.select("node", F.posexplode(F.array(*cols)).alias("r", "fp"))
    name = lambda x: F.xxhash64(F.col("r"), F.col(x))
    links = common.materialize(spark, _links(spark, each.select("r", "fp").distinct()).select(name("a").alias("a"), name("b").alias("b")))
    ties = each.select("node", name("fp").alias("id"))
    # Only fingerprints that link or that several classes have tie anything together.
    busy = links.select(F.col("a").alias("id")).unionAll(links.select("b")).unionAll(ties.groupBy("id").count().where("count > 1").select("id")).distinct()
    edges = ties.join(busy, "id", "left_semi").select(F.col("node").alias("a"), F.col("id").alias("b"))
    proposed = components(spark, links.unionAll(edges))
    texts = prints.groupBy("text_hash").agg(F.min(key).alias("least"), F.any_value("node").alias("node"))
    texts = common.materialize(spark, texts.join(proposed, "node", "left").select("text_hash", "least", F.coalesce("root", "node").alias("proposed")))
    roots = components(spark, _verified(spark, texts, docs, key, text, block))
    of = common.materialize(spark, _component_ids(texts, roots, "text_hash"))
    session.drop(classes, links, texts)
    return prints.select(key, "text_hash").join(of, "text_hash").select(key, "text_hash", "component_id")


def dedup(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component of near copies: that of the least key. Of rows that repeat a key, one
    stays. Of rows with a null key, whose component has no other key, one for each text stays."""
    names, docs = docs.columns, common.numbered(docs, key, text)
    found = common.materialize(spark, near_copies(spark, docs, key, text))
    keep = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    named = docs.where(F.col(key).isNotNull()).join(keep, key, "left_semi")
    # The join has already dealt and sorted the rows by key.
    once = named.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(key))).where("_nth = 1").select(*docs.columns)
    lost = found.where(F.col(key).isNull() & F.col("component_id").isNull()).select("text_hash").distinct()
    if lost.isEmpty():
        return once.toDF(*names)
    nameless = docs.where(F.col(key).isNull()).withColumn("text_hash", F.xxhash64(text)).join(lost, "text_hash", "left_semi")
    return once.unionByName(nameless.dropDuplicates(["text_hash"]).select(*docs.columns)).toDF(*names)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
