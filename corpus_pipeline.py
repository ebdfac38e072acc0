"""From raw documents to packed training sequences: each stage is one operator, applied to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.llm import decontamination, language, line_dedup, packing, simhash
from veil.llm.common import held_out, stored, table

#: Bytes of rows that go to a Python worker together.
BATCH = 1 << 22


def in_small_batches(spark: SparkSession) -> None:
    """Rows go to Python ``BATCH`` bytes at a time from here on. It stays set, unlike in ``packing``: a stage's last step only runs when its rows
    are read, and executors keep what the largest batches took."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the languages are learned from the labelled documents that are not held out."""
    in_small_batches(spark)
    model = language.fit(table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").where(~held_out(1, 3)))
    return language.known_languages(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; those of which nothing is left go, n_chars follows the text."""
    rows = line_dedup.deduplicated(docs, 50)
    rows = rows.where((F.col("__deleted") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).drop("__deleted")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked over the pivot tables (three-word shingles, two bits); then of what is
    left, whose near copies lie further apart, one of each group of similarity 0.8 in five-word shingles."""
    in_small_batches(spark)
    return simhash.without_near_copies(stored(simhash.one_per_print_group(docs, shingle=3, max_bits=2), "prints"), shingle=5, similarity=0.8)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a tenth of its length in edits."""
    in_small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), 0.1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens. Executors still hold what the stages before needed, so a worker keeps a fifth of the words it would alone, and
    none of them beyond its task."""
    return packing.packed(docs, packing.tokenizer_json(), cache=1 << 17, keep=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: The learned language filter and the tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
