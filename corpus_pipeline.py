"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, substring dedup, packing.

Each stage takes all that its predecessor kept.  All but the last return the
columns of documents; the last returns the packed pieces with their token ids.

In every stage a null text counts as an empty one and an empty table gives no
rows.  Rows are told apart by their place (file and row), so doc_ids may be null
or repeat; further columns than those of documents are left out by substring
dedup and packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, langid, minhash, packing, substrings
from tessera.llm.common import Work

LEAST_SCORE = 0.5

#: SQL can't express trained language ID or tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a recognised language. Learns from the labelled rows of its input;
    documents without letters, and those that no language explains better than all others together, go.
    Without any labelled row nothing can be told apart, and documents with letters stay."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    sent = spark.sparkContext.broadcast(model)
    return docs.where(langid.accepted(sent, LEAST_SCORE)(F.col("text")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: the one with the largest doc_id, one of rows repeated whole."""
    return exact.distinct_rows(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates; rows are told by place, so
    a row goes only by its own text even where its doc_id repeats. Documents without words or doc_id stay."""
    return minhash.distinct_rows(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows. Every document stays, an empty one too."""
    cut = substrings.dedup_substrings(spark, docs, with_text=True, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece, with its ids."""
    return packing.pack(spark, docs, packing.default_tokenizer(), with_ids=True)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.cut(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
