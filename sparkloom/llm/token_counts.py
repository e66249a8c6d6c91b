"""Token counts through a digest cache.

Stored counts are keyed by the digest of a text's normalised content and the digest of the tokenizer's version. A run
finds the digests that the cache lacks, encodes one text for each of them, appends those counts to the cache, and then
joins the whole table to it.

Shuffles: digests only to find what is missing; one text of each digest and task, by digest, of all texts or, where few
digests are missing, of those alone; digests and counts for the last join, which AQE may split where one digest is hot.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids each get their row; an empty table
gives an empty result and leaves the cache as it is; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm._shared import Scratch, fresh_path, stored
from sparkloom.llm.tokenizing import tokenizer, version_digest

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
LIMIT = 2048
#: Up to so many missing digests are broadcast to pick their texts.
BROADCAST_ROWS = 200_000


def normalised(text: Column, by_word: bool) -> tuple[Column, str]:
    """The content that a count depends on, and the rule's name. Kinds of white space matter only to some tokenizers."""
    text = F.coalesce(text, F.lit(""))
    if by_word:
        return F.translate(text, "\t\n\x0b\x0c\r", "     "), "white space alike"
    return text, "exact"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one version; empty if there is no cache yet. Entries appended twice count once."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of docs: key, n_bytes, n_tokens, over_limit. cache: a folder that all machines share, kept between runs."""
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-counts")
    content, rule = normalised(F.col(text), tokenizer(tokenizer_path).by_word)
    version = version_digest(tokenizer_path, rule)
    digested = docs.select(
        F.col(key).alias("_key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("_digest"),
    )
    rows = stored(digested, "digests")
    store = read_cache(spark, cache, version)
    missing = rows.select("_digest").distinct().join(store.withColumnRenamed("digest", "_digest"), "_digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(tokenizer_path)
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                counts = known.count(part.column("_text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), part.column("_digest"), pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"])

    with Scratch(spark) as tables:
        texts = _texts_of(docs, missing, store.isEmpty(), text, content, tables)
        texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, rows["_digest"] == counts["digest"]).select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _texts_of(docs: DataFrame, missing: DataFrame, all_missing: bool, text: str, content: Column, tables: Scratch) -> DataFrame:
    """One text for each missing digest. Copies of a text meet as one row from each task."""
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("_digest"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if not all_missing:
        missing = tables.table(missing, "missing")
        if missing.count() <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(missing), "_digest", "left_semi")
            return texts.groupBy("_digest").agg(F.first("_text").alias("_text"))
        return texts.groupBy("_digest").agg(F.first("_text").alias("_text")).join(missing, "_digest", "left_semi")
    return texts.groupBy("_digest").agg(F.first("_text").alias("_text"))
