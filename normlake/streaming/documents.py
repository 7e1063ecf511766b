"""Documents as a stream: each micro-batch of whole documents (doc_id, pages) goes through the batch operators.

Citations run over page breaks and headers repeat over pages, so that the unit of the stream is a document, not a page. Nothing is kept
between batches; a batch that is run again writes the same rows to the same place.

Defined results: those of the batch operators; a null or empty array of pages is a document without pages; an empty batch writes an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normlake.operators import citations, cleaning

SCHEMA = "doc_id bigint, pages array<string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def pages(documents: DataFrame) -> DataFrame:
    """doc_id, page (from 1), raw."""
    return documents.select("doc_id", F.posexplode("pages").alias("k", "raw")).select("doc_id", (F.col("k") + 1).alias("page"), "raw")


def start(documents: DataFrame, known: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Citations of each batch to sink(frame, batch number)."""

    def one(batch: DataFrame, number: int) -> None:
        sink(citations.extract(cleaning.clean_documents(pages(batch)), known), number)

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, over what an earlier try of the same batch left."""
    return lambda frame, number: frame.write.mode("overwrite").parquet(f"{path}/batch={number}")
