"""The corpus pipeline: five llm operators in a row, each over all documents that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumoji.llm import bpe, decontaminate, substring, toxicity, widehash
from kumoji.llm.common import BLANKS, Scratch, free_name, table, tokenizer_path


#: Bytes of an Arrow batch. A task holds a batch several times over, in the JVM's buffers and in its Python worker.
BATCH = 4 << 20


def small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with batches of about BATCH bytes and not of 10,000 rows. The session keeps the setting, as the plan is made when the rows are read."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8 by wide fingerprints; op1's digest (three words, three of 64 bits) is a contract of op1 only."""
    return widehash.near_dedup(docs, width=5, similarity=0.8)


@small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a document that loses all its words goes, and n_chars follows the text."""
    had, words = free_name(docs, "had"), F.length(F.translate(F.coalesce("text", F.lit("")), BLANKS, "")) > 0
    cut = substring.dedup(docs.withColumn(had, words))
    kept = cut.where(~F.col(had) | words)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: The toxicity scores and the near copies have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written to the shared folder, and what it was made from goes once it is. The last stage reads
    the table before it, which stays until the caller has read the rows and removes the folder."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs, path = scratch.write(stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
