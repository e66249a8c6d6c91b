"""A corpus pipeline: each stage takes the documents that the stage before it kept.

Defined cases, in every stage: a null text counts as empty. The quality rules drop texts without words, so later stages
see none unless they are called alone; there texts without words stay. Rows without an id are documents of their own;
rows that repeat both id and text are one document and stay or go together. Tables may be empty, and columns beside
doc_id and text pass through untouched, but for n_chars, which follows the text. The last stage returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import decontaminate, near_duplicates, quality, repeated_text
from sparkloom.llm._shared import Scratch, small_batches
from sparkloom.llm._text import read
from sparkloom.llm.queries import bpe_digests

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go."""
    small_batches(spark)
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: that with the least id."""
    small_batches(spark)
    return near_duplicates.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere go. Every document stays; n_chars follows its text."""
    small_batches(spark)
    removed = repeated_text.remove(docs)
    return removed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else removed


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids: doc_id, n_tokens, and digests of the ids and of what they decode to."""
    small_batches(spark)
    return bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: Byte-level BPE and order MinHash can't be put in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next stage has written its own."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as store:
        for name, stage in STAGES[:-1]:
            made = store.table(stage(spark, docs, sf_dir), name, keep=name == STAGES[-2][0])
            store.drop(docs)
            docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
