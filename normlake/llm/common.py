"""Helpers shared by the training-data operators: reading, cutting lineage, Arrow maps, prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from normlake import session
from normlake.session import ensure_code

#: Rows of an Arrow batch: whole texts of any length have to fit in a Python worker.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lost executors cost no recomputation of what came before."""
    return session.materialize(df)


def numbered(df: DataFrame, *keep: str) -> DataFrame:
    """df with all columns but `keep` renamed to c0, c1, ..., so that none has the name of a column that an operator adds."""
    return df.toDF(*(c if c in keep else f"c{k}" for k, c in enumerate(df.columns)))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch, in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                yield function(b.slice(at, BATCH_ROWS))

    ensure_code(df.sparkSession)
    return df.mapInArrow(run, schema)


def ship(spark: SparkSession, value):
    """Broadcast a model or automaton whose size its maker bounds."""
    return spark.sparkContext.broadcast(value)


_made: dict = {}


def once(key: str, make: Callable):
    """make(), once for each key and Python worker; the last two results stay."""
    if key not in _made:
        while len(_made) >= 2:
            _made.pop(next(iter(_made)))
        _made[key] = make()
    return _made[key]


def trim() -> None:
    """Give memory that a fit has used and freed back to the system, where it can be: the driver goes on with other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """True for rows kept from every fit: crc32 of the id as text divides by 5. A null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def sample_of(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One row of each of `most` keys (of all, if fewer): the least in the other columns. The keys are those with the smallest hashes, so the
    choice is the same whatever the rows' order, partitions or repetitions, and is full as long as there are keys.

    rows is read two to four times, but for the last time with its keys alone. At most `most` hashes come to the driver.
    """
    h = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(7)), 1)
    n = rows.count()
    share = min(1.0, 4 * most / max(1, n))
    while True:
        # With many repetitions few of the hashes below the share differ: then more of them are looked at.
        some = rows.select(h.alias("_h")).where(F.col("_h") <= min(int(share * (1 << 63)), (1 << 63) - 1))
        picked = [r[0] for r in some.distinct().orderBy("_h").limit(most).collect()]
        if share >= 1 or len(picked) == most:
            break
        share = min(1.0, share * 64)
    kept = rows.where(h <= (picked[-1] if picked else -1))
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return kept.distinct()
    return kept.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_o")).select(*keys, "_o.*").select(*rows.columns)


def prefix_sum(df: DataFrame, by: str, order: str, bucket: Column, value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` in `order` within `by`, whatever share of the rows one key holds.

    bucket must rise with `order`: sums of buckets are added up first (rows: keys x buckets), then only rows of the same key and bucket meet in one task.
    """
    with_bucket = df.withColumn("_bucket", bucket)
    sums = with_bucket.groupBy(by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        with_bucket.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, (F.col(by) == F.col("_by")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(out, F.col("_run") + F.col("_start"))
        .drop("_bucket", "_by", "_b", "_run", "_start")
    )
