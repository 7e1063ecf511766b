"""Which text items does a snippet cover? Matching on a stream without blanks.

Defined results: null strings are empty; targets under two characters and rows without doc_id or page hit nothing; repeated targets hit once;
every occurrence counts, overlapping ones too; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from normlake.functions import text as T


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.nfkc(c), "\\u00AD", ""), f"{T.WS}+", "")


def hits(items: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, page, item_no: items (doc_id, page, item_no, str) that an occurrence of a target (doc_id, page, target; two characters or more) covers. A page is small: its stream is one row."""
    part = items.select("doc_id", "page", "item_no", squeezed(F.coalesce("str", F.lit(""))).alias("part"))
    before = Window.partitionBy("doc_id", "page").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = part.withColumn("start", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0))).withColumn("end", F.col("start") + F.length("part"))
    streams = part.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "part"))), lambda x: x["part"]), "").alias("stream"))
    wanted = targets.select("doc_id", "page", squeezed(F.col("target")).alias("t")).where(F.length("t") >= 2).distinct()
    at = F.filter(F.sequence(F.lit(1), F.length("stream") - F.length("t") + 1), lambda k: F.substring(F.col("stream"), k, F.length("t")) == F.col("t"))
    found = wanted.join(streams, ["doc_id", "page"]).where(F.contains("stream", F.col("t")))
    spans = found.select("doc_id", "page", F.explode(at).alias("k"), F.length("t").alias("n")).select("doc_id", "page", (F.col("k") - 1).alias("s"), (F.col("k") - 1 + F.col("n")).alias("e"))
    return placed.join(spans, ["doc_id", "page"]).where((F.col("end") > F.col("s")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("start"))).select("doc_id", "page", "item_no").distinct()
