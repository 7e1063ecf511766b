"""Exact top-k search by inner product with KD-trees per shard.

A top tree of median splits, fitted to a bounded sample, deals the vectors to regions; a region of more than `shard` vectors is dealt on to
shards of that size. Every shard's tree is built once: it splits at the median of the widest dimension and keeps the tight bounding box of
every node. Of equal vectors only the k + 1 with the least ids enter the trees, as no query's k best can hold more.

Boxes from the upper levels of all trees, BOXES at most, are known to every task. A query goes first to its home, the shard of the box whose
middle has the largest inner product with it; then, with the k-th score found there, to those shards alone that have a box in which that score
is possible. Within a tree it goes best-first: nodes in order of their boxes' bounds, until no box can beat the k-th best found.

Queries meet a shard's tree in blocks of `block`; no task holds all vectors or all queries. Scores are integers: products are taken in double
precision where every sum is below 2 ** 53 and in Python integers otherwise.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows whose vec_id is null; a shorter
vector counts as filled up with zeros; a query's own row is one row of its vec_id and vector, so repeated rows are candidates of each other
and repeated queries are answered each (all their answers carry the same query_id); ties go to the smaller vec_id; a query with fewer
candidates than k returns them all; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from normlake.llm import common

K, SCALE, EVERY = 20, 64, 20
#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 8192, 4096, 128
#: Regions of the top tree; numbers in its sample (vectors times dimensions), and sampled vectors that a region needs; boxes that all tasks know.
REGIONS, SAMPLE, EACH, BOXES = 1024, 1 << 21, 32, 8192
_LIMIT = float(1 << 53)


def integers(embedding: str = "embedding", scale: int = SCALE):
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: str = "embedding"):
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<bigint> array as int64, filled up with zeros to `width`."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


class Tree:
    """Median splits, tight boxes; rows are put in leaf order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        # Equal points are neighbours in the order of ids, and boxes of equal points need no split.
        order, self.nodes, self.kids = np.argsort(ids, kind="stable"), [], []
        low, high = [], []
        todo = [(order, -1)]
        rows, at = [], 0
        while todo:
            own, parent = todo.pop()
            k = len(self.nodes)
            if parent >= 0:
                self.kids[parent].append(k)
            p = points[own]
            low.append(p.min(0))
            high.append(p.max(0))
            self.kids.append([])
            wide = high[-1] - low[-1]
            if len(own) <= leaf or not wide.any():
                for i in range(0, len(own), leaf):
                    rows.append(own[i : i + leaf])
                self.nodes.append((at, at + len(own)))
                at += len(own)
                continue
            self.nodes.append(None)
            split = np.argpartition(p[:, int(wide.argmax())], len(own) // 2)
            todo += [(np.sort(own[split[: len(own) // 2]]), k), (np.sort(own[split[len(own) // 2 :]]), k)]
        rows = np.concatenate(rows)
        self.ids, self.points = ids[rows], narrow(points[rows])
        self.low, self.high = narrow(np.array(low)), narrow(np.array(high))

    def upper(self, most: int) -> list[int]:
        """Nodes, `most` at most, whose boxes hold all vectors: from the root on, the widest is opened first."""
        width = (self.high.astype(float) - self.low).max(1)
        open_, out = [(-width[0], 0)], []
        while open_ and len(open_) + len(out) < most:
            _, n = heapq.heappop(open_)
            if self.kids[n]:
                for c in self.kids[n]:
                    heapq.heappush(open_, (-width[c], c))
            else:
                out.append(n)
        return sorted(out + [n for _, n in open_])


def narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    top = int(np.abs(m).max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def kind_of(*parts: np.ndarray):
    """double where every inner product of the parts is exact in it, else Python integers."""
    top = 1.0
    for m in parts:
        top *= float(np.abs(m).max(initial=0))
    return np.float64 if top * parts[0].shape[1] < _LIMIT else object


class Regions:
    """The top tree: median splits of a sample, the largest part first. at() gives the region of each row of a matrix."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.dim, self.cut, self.kids = [-1], [0], [(0, 0)]
        parts = [(-len(sample), 0, sample)]
        while parts and len(parts) < regions:
            _, node, m = heapq.heappop(parts)
            wide = m.max(0) - m.min(0) if len(m) else np.zeros(1)
            d = int(wide.argmax())
            if not wide.any():
                break
            cut = int(np.median(m[:, d]))
            cut += bool((m[:, d] < cut).sum() == 0)
            below = m[:, d] < cut
            self.dim[node], self.cut[node], self.kids[node] = d, cut, (len(self.dim), len(self.dim) + 1)
            for side in (below, ~below):
                heapq.heappush(parts, (-int(side.sum()), len(self.dim), m[side]))
                self.dim.append(-1)
                self.cut.append(0)
                self.kids.append((0, 0))
        leaves = [n for n, d in enumerate(self.dim) if d < 0]
        self.number = {n: k for k, n in enumerate(leaves)}

    def at(self, m: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(m), np.int32), [(0, np.arange(len(m)))]
        while todo:
            node, rows = todo.pop()
            if self.dim[node] < 0:
                out[rows] = self.number[node]
            elif len(rows):
                below = m[rows, self.dim[node]] < self.cut[node]
                todo += [(self.kids[node][0], rows[below]), (self.kids[node][1], rows[~below])]
        return out


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, own: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """For each query, its best candidates here, at most k, as (score, vec_id): none that k others beat for sure. floor: the k-th score so far."""
    kind = kind_of(queries, tree.points)
    points, low, high, q = (m.astype(kind) for m in (tree.points, tree.low, tree.high, queries))
    bounds = reach(q, low, high)
    out = []
    for i in range(len(queries)):
        bound, best, kth, me = bounds[i], [], floor[i], int(ids[i])
        skip = 1  # a row of the query's own
        heap = [(-bound[0], 0)]
        while heap:
            b, n = heapq.heappop(heap)
            # A box that can only reach the k-th score may hold a smaller vec_id.
            if kth is not None and -b < kth:
                break
            if tree.nodes[n] is None:
                for c in tree.kids[n]:
                    if kth is None or bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, z = tree.nodes[n]
            score = points[a:z] @ q[i]
            near = np.arange(z - a) if kth is None else np.flatnonzero(score >= kth)
            for j in near.tolist():
                v = int(tree.ids[a + j])
                if v == me and skip and np.array_equal(tree.points[a + j], queries[i]):
                    skip = 0
                    continue
                item = (int(score[j]), -v)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        out.append([(s, -v) for s, v in sorted(best, reverse=True)])
    return out


def _dealt(spark: SparkSession, vectors: DataFrame, k: int, width: int, shard: int) -> tuple[DataFrame, int]:
    """vectors with their shard, without copies that no answer needs; the number of shards."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = common.materialize(spark, vectors.withColumn("_n", nth).where(F.col("_n") <= k + 1).select("vec_id", "v"))
    n = some.count()
    most = max(EACH, SAMPLE // width)
    sample = common.sample_of(some, ["vec_id", "v"], most).select("v").toArrow().column("v")
    top = Regions(matrix(sample, width), max(1, min(-(-n // shard), REGIONS, len(sample) // EACH)))
    shipped = common.ship(spark, top)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(shipped.value.at(matrix(b.column("v"), width)), pa.int32())], names=["vec_id", "v", "region"])

    placed = common.materialize(spark, common.arrow_map(some, run, "vec_id bigint, v array<bigint>, region int"))
    sizes = {r.region: r["n"] for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, -(-sizes.get(r, 0) // shard)) for r in range(len(top.number))]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    of = lambda values: F.get(F.array(*(F.lit(int(x)) for x in values)), F.col("region"))
    return placed.withColumn("shard", (of(first[:-1]) + F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), of(parts))).cast("int")).drop("region"), first[-1]


def _trees(spark: SparkSession, vectors: DataFrame, width: int, boxes: int) -> DataFrame:
    """shard, tree (bytes), boxes (bytes of its upper boxes): a row for each shard."""

    def run(t: pa.Table) -> pa.Table:
        tree = Tree(t.column("vec_id").to_numpy(), matrix(t.column("v"), width))
        upper = tree.upper(boxes)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "boxes": pa.array([pickle.dumps((tree.low[upper], tree.high[upper]))], pa.binary())})

    return common.materialize(spark, vectors.groupBy("shard").applyInArrow(run, "shard int, tree binary, boxes binary"))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id bigint, v array<bigint>; a query's own row among the vectors is left out."""
    widest = lambda df: df.agg(F.max(F.size("v"))).first()[0] or 1
    width = max(1, widest(vectors), widest(queries))
    dealt, shards = _dealt(spark, vectors, k, width, shard)
    trees = _trees(spark, dealt, width, max(1, BOXES // shards))
    # Boxes are told apart by shard while there are BOXES shards at most; beyond, by groups of shards, whose boxes are put together.
    groups = min(shards, BOXES)
    low, high, owner = [], [], []
    for r in trees.select("shard", "boxes").coalesce(32).toLocalIterator():
        a, b = pickle.loads(r.boxes)
        low, high, owner = [*low, *a.astype(np.int64)], [*high, *b.astype(np.int64)], [*owner, *[r.shard * groups // shards] * len(a)]
        if len(owner) > 2 * BOXES:
            low, high, owner = _put_together(low, high, owner)
    if shards > BOXES:
        low, high, owner = _put_together(low, high, owner)
    if not owner:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    known = common.ship(spark, (narrow(np.array(low)), narrow(np.array(high)), np.array(owner), groups, shards))
    queries = common.materialize(spark, queries.select("vec_id", "v").withColumn("no", F.monotonically_increasing_id()))

    def routed(asked: DataFrame, home: bool) -> DataFrame:
        """no, vec_id, v, kth and shard: each query's home, or all other shards in which its k-th score is possible."""

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            lo, hi, own, n, of = known.value
            q = matrix(b.column("v"), width)
            kind = kind_of(q, np.concatenate([lo, hi]))
            bound = reach(q.astype(kind), lo.astype(kind), hi.astype(kind))
            if home:
                # Not the farthest corner but the middle of a box tells how good its vectors are: a high k-th score from the start closes most boxes.
                middle = q.astype(float) @ (lo.astype(float) + hi.astype(float)).T
                best, at = own[middle.argmax(1)] if len(q) else np.zeros(0, int), b.column("no").to_numpy()
                rows, to = np.arange(len(q)), best * of // n + at % np.maximum(1, (best + 1) * of // n - best * of // n)
            else:
                rows, to = [], []
                for i, (kth, was) in enumerate(zip(b.column("kth").to_pylist(), b.column("home").to_pylist())):
                    near = np.unique(own if kth is None else own[bound[i] >= kth])
                    more = np.concatenate([np.arange(-(-g * of // n), -(-(g + 1) * of // n)) for g in near]) if len(near) else np.zeros(0, int)
                    more = more[more != was]
                    rows.append(np.full(len(more), i))
                    to.append(more)
                rows, to = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, to))
            take = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("no", "vec_id", "v", "kth")] + [pa.array(to, pa.int32())], names=["no", "vec_id", "v", "kth", "shard"])

        return common.materialize(spark, common.arrow_map(asked, run, "no bigint, vec_id bigint, v array<bigint>, kth bigint, shard int"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = search(pickle.loads(left.column("tree")[0].as_py()), right.column("vec_id").to_numpy(), matrix(right.column("v"), width), right.column("kth").to_pylist(), k)
        flat = [(n, q, s, v) for n, q, f in zip(right.column("no").to_pylist(), right.column("vec_id").to_pylist(), found) for s, v in f]
        cols = list(zip(*flat)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("no", "query_id", "score", "vec_id"), cols)})

    def meet(asked: DataFrame) -> DataFrame:
        """Answers of the shards: a shard's queries come in blocks, its tree once for each."""
        sizes = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        sizes = F.broadcast(sizes) if shards <= BOXES else sizes
        right = asked.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")).drop("blocks")
        left = trees.join(sizes, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, "no bigint, query_id bigint, score bigint, vec_id bigint")

    at_home = routed(queries.withColumn("kth", F.lit(None).cast("bigint")), True)
    first = common.materialize(spark, meet(at_home))
    if shards == 1:
        found = first
    else:
        kth = first.groupBy("no").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
        away = routed(at_home.select("no", "vec_id", "v", F.col("shard").alias("home")).join(kth, "no", "left"), False)
        found = first.unionAll(meet(away))
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _put_together(low: list, high: list, owner: list) -> tuple[list, list, list]:
    """One box for each owner."""
    order = np.argsort(owner, kind="stable")
    who, at = np.unique(np.array(owner)[order], return_index=True)
    return list(np.minimum.reduceat(np.array(low)[order], at)), list(np.maximum.reduceat(np.array(high)[order], at)), who.tolist()


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("bigint"), integers().alias("v"))
    return top_k(spark, rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
