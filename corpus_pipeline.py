"""A training corpus from documents: quality, line dedup, near duplicates, benchmark passages, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from varlake.llm import decontaminate, line_dedup, piece_codec, quality, similar
from varlake.llm.queries import table, tokenizer_path
from varlake.llm.storage import staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of similar ones."""
    return similar.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded and n_tokens; the other columns of documents end here, as the decoded text stands for the text."""
    return piece_codec.encode_decode(docs, tokenizer_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("similar", keep_one_of_similar), ("decontaminate", drop_leaks), ("piece_codec", encode)]
ORACLE_SQL = None  # a fitted classifier can't be expressed in SQL; tests/llm hold every stage against brute force on a small fixture


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
