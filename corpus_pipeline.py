"""The corpus pipeline: quality, repeated lines, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import boosted_quality, byte_bpe, line_dedup, mixing, near_dedup
from plumbline.llm.common import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    forest = boosted_quality.train(docs, boosted_quality.training_labels(read(spark, sf_dir, "labels")))
    return boosted_quality.score(docs, forest, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; n_chars follows."""
    out = line_dedup.dedup_lines(docs)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words a shingle, similarity 0.8)."""
    return near_dedup.near_dedup(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every copy, and of the bytes that they decode to."""
    return byte_bpe.digests(byte_bpe.round_trip(docs))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicate removal", near_duplicates), ("source mixture", mixture), ("byte-level BPE", tokens)]

#: A boosted forest and connected components can't be put in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
