"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, mix. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs; all but the last return the columns of documents.

Defined results, for every stage: a null text is an empty one; an empty table gives an empty one; repeated rows are judged each, but the
near-duplicate stage keeps one of rows that repeat an id; rows with a null id are judged by their text, and the near-duplicate stage keeps one
for each text that is no copy of a document with an id. Columns called like an operator's own keep their values in all stages but the last,
which returns its own columns alone. The details are those of the operators, in their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normlake import session
from normlake.llm import common, op4_simhash, op5_secrets, op7_mixing, op8_quality, op10_decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is at least one half. Rated documents of `docs` that aren't held out teach."""
    return op8_quality.select_good(spark, docs, op8_quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are alike to 0.8 or more: that of the least doc_id."""
    return op4_simhash.dedup(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return op10_decontaminate.decontaminate(spark, docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific live-looking secrets masked and n_chars set anew."""
    return op5_secrets.redact(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes."""
    return op7_mixing.mix_of(spark, docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: Fitted classifiers, XXH64 fingerprints and components are beyond SQL: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table documents, each written to the shared folder and read again. What a stage wrote on its way, and its
    predecessor's output, are deleted once its own output is there."""
    docs, point = common.table(spark, sf_dir, "documents"), session.mark(spark)
    for _, stage in STAGES:
        docs = common.materialize(spark, stage(spark, docs, sf_dir))
        session.drop_since(spark, point, keep=1)
    return docs
