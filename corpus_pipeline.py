"""A corpus pipeline over documents: every stage works on all that the one before kept.

Stages: quality classifier, SimHash near-dedup, substring dedup, benchmark decontamination, SentencePiece encoding. Each
function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarium.llm import decontaminate, dropout, near, quality, substrings
from planarium.llm.common import discard, prepare, read, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is under one half go.

    A null or empty text is judged as an empty one; without labels nothing goes. Rows that repeat go or stay together,
    and a null doc_id goes by its text. All columns come back as they were; no rows give no rows.
    """
    return quality.select(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near-duplicates, chains included, the one with the smallest doc_id stays.

    Null and empty texts are near-duplicates of each other only. Of rows of one doc_id that are near-duplicates one stays,
    by a total order of their columns; rows without a doc_id all stay. All columns come back as they were; no rows give
    no rows.
    """
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word passages that a document with a smaller doc_id holds too go; n_chars follows a text that changes.

    Null and empty texts, and rows without a doc_id, come back as they were, as does every other column, whatever its
    name; rows that repeat lose the same words. No rows give no rows.
    """
    names = ["n_words", "n_removed", "kept_sha256"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [f"{name}_" for name in names]
    found = substrings.remove_repeats(docs, names=tuple(names))
    if "n_chars" in docs.columns:
        size = F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", size)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go.

    Null and empty texts stay, rows that repeat go or stay together, a null doc_id goes by its text, and without a
    benchmark nothing goes. All columns come back as they were; no rows give no rows.
    """
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text_sha256, lossless) for every document.

    A null or empty text has no tokens; rows that repeat get the same ones; a null doc_id stays null. No rows give no rows.
    """
    return dropout.round_trip(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokens; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table is deleted once the next is written."""
    docs = read(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        found = written(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = found
    return docs
