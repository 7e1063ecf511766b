"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Slot j of the mix is the point frac(j / golden ratio), taken on the lattice of 2 ** 31 points; the cumulative target shares map points to
sources, so that every stretch of the mix holds each source in proportion. The slots of a source are ranked; slot k takes the k-th block
of `block_words` words from the source's documents in shuffled order (by MD5 of the id), again from the start when they end, three
times at most. Points give a source its number of blocks but for a few: the schedule's end adds those it lacks, and a source's last block is
cut, so that it gives its target to the word. Targets stop at three times the source's size and the excess is shared out by weight until none
is above.

Nothing is gathered by source in one task: ranks and offsets come from sums over buckets first, and blocks meet documents by (source, block).

Defined results: null text has size 0, as has an empty one, and documents of size 0 are taken 0 times; a null source is a source, last
in order; repeated rows each count as documents; a null doc_id shuffles as an empty id; an empty table gives an empty result; sources
without words have target 0. Extra columns are ignored by `mix_of` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from normlake.llm import common

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK_WORDS = 1024
#: 2 ** 31 / golden ratio, odd: the lattice of slot points.
POINTS, STEP = 1 << 31, 1327217885
#: Slots that are ranked together before their counts are added up; cells of the interval in which points meet sources.
RUN, CELLS = 1 << 16, 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes: source, source_size (a row for each source). Adds `nth`, `target` and [low, high), the source's share of the points.

    The only frame without a partition key in this module: a row for each source, already summed up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("nth", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    # Shares rise together until a source is full: sources fill up in order of cap / weight.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    full, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(full), F.lit(0))).cast("double") / F.sum("weight").over(rest))
    # The level is that of the first source that isn't full at it; the last one never is more than full.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(all_)["level"])
    s = s.withColumn("target", F.round(F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))), 6))
    upto = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum("target").over(upto) / F.sum("target").over(all_)
    return s.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("nth")), F.lit(0.0))).select("source", "source_size", "nth", "target", "low", "high")


def schedule(spark: SparkSession, shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, nth (its source), rank (from 0, within the source): as many slots of a source as its target has blocks. shares: what targets() returns."""
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    end = -(-total // block_words)
    slots = spark.range(end).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", F.pmod(F.pmod(F.col("slot"), F.lit(POINTS)) * STEP, F.lit(POINTS)) / F.lit(float(POINTS)))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = shares.where("high > low").select("nth", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    dealt = slots.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "nth", F.lit(1).cast("bigint").alias("one"))
    ranked = common.materialize(spark, common.prefix_sum(dealt, "nth", "slot", F.floor(F.col("slot") / RUN), "one", "rank").select("slot", "nth", "rank"))
    # What the points lack of a source's blocks comes at the end, source by source; what they have too much goes.
    due = shares.select("nth", F.ceil(words_due() / block_words).alias("blocks"))
    given = due.join(ranked.groupBy("nth").agg(F.count(F.lit(1)).alias("n")), "nth", "left").select("nth", "blocks", F.coalesce("n", F.lit(0)).alias("n"))
    more = given.where("blocks > n").select("nth", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank")).select((F.lit(end) + F.col("nth")).cast("bigint").alias("slot"), "nth", F.col("rank").cast("bigint").alias("rank"))
    return ranked.join(due, "nth").where(F.col("rank") < F.col("blocks")).select("slot", "nth", "rank").unionAll(more)


def words_due() -> Column:
    """A source's target in whole words."""
    return F.round("target").cast("bigint")


def mix_of(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each row of docs."""
    sized = common.materialize(spark, docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("mixed")))
    shares = common.materialize(spark, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), epochs=epochs))
    # Sources by number: a few bytes a row, and null is a number too.
    own = sized.withColumn("_s", F.xxhash64("source")).join(shares.select(F.xxhash64("source").alias("_s"), F.col("source").alias("_source"), "nth", "source_size", "target"), "_s")
    own = own.where(F.col("source").eqNullSafe(F.col("_source"))).drop("_s", "_source")
    # Equal ids (repeated rows) get offsets in some order; it makes no difference, but must be the same in every run: by size.
    placed = common.prefix_sum(own.where("size > 0").withColumn("order", F.struct("mixed", "size")), "nth", "order", F.substring("mixed", 1, 3), "size", "offset").drop("order")
    placed = common.materialize(spark, placed)
    slots = schedule(spark, shares, block_words).select("nth", F.col("rank").alias("block"))
    # Pass e over a source begins at e x source_size: one tape, cut into equal blocks, of which those with a slot are taken.
    passes = placed.select("nth", "source_size", "offset", "size", words_due().alias("due"), F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("pass"))
    begin, end = F.col("pass") * F.col("source_size") + F.col("offset"), F.col("pass") * F.col("source_size") + F.col("offset") + F.col("size")
    met = passes.withColumn("begin", begin).withColumn("end", end).withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    words = F.least("end", (F.col("block") + 1) * block_words, "due") - F.greatest("begin", F.col("block") * block_words)
    met = met.where("block * %d < due" % block_words).select(F.col("nth").alias("_n"), F.col("offset").alias("_o"), "block", F.greatest(words, F.lit(0)).alias("words"), F.col("nth"))
    taken = met.join(slots, ["nth", "block"]).groupBy("_n", "_o").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, (F.col("nth") == F.col("_n")) & (F.col("offset") == F.col("_o")), "left")
    names = ("doc_id", "source", "size", "source_size", "target")
    return out.select(*names, F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")).unionAll(own.where("size = 0").select(*names, F.lit(0).cast("bigint")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_of(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source),
s1 AS (SELECT *, CASE nth % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
lv AS (SELECT level AS l FROM s2 WHERE level * weight <= cap ORDER BY ratio, nth LIMIT 1),
s3 AS (SELECT source, source_size, nth, round(least(CAST(cap AS DOUBLE), coalesce(l * weight, 0.0)), 6) AS target FROM s2 LEFT JOIN lv ON true),
placed AS (SELECT sized.*, s3.nth, source_size, target, coalesce(sum(size) OVER (PARTITION BY s3.nth ORDER BY mixed, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sized JOIN s3 ON sized.source IS NOT DISTINCT FROM s3.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(o + size, due) - o) + greatest(0, least(source_size + o + size, due) - source_size - o) + greatest(0, least(2 * source_size + o + size, due) - 2 * source_size - o) AS BIGINT) AS taken
FROM (SELECT *, CAST(round(target) AS BIGINT) AS due FROM placed)
"""
