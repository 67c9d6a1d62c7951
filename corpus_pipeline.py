"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage as Parquet in the shared
checkpoint folder and rereads it as the next stage's documents. All stages but the last return the columns of
``documents``.

Defined results, stage by stage as in the operators' modules: null and empty texts fail the quality rules; rows are told apart by id
and text, so null and repeated ids are documents of their own until the n-gram join, which keeps one row of each group
(smallest id, null last, then text hash); very long texts are judged, deduplicated, mixed and packed whole; extra columns
pass through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import lines, mixing, ngram_join, packing, quality
from quillspark.llm.shared import read, shared_path, small_batches
from quillspark.session import prepare


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def _prepare(spark: SparkSession) -> None:
    prepare(spark)
    small_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return _counted(lines.dedup_lines(docs, min_chars=20, min_docs=3))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest document id of a group stays."""
    _prepare(spark)
    return ngram_join.keep_representatives(docs, shingle_words=5, num=80, den=100)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return _counted(mixing.mixed_documents(docs, block_words=512))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_sources),
    ("packing", pack_sequences),
]

# Compression ratios and token ids are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
