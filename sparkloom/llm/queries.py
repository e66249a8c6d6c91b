"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import byte_bpe, chat_format, decontaminate, html_text, lexical_search, line_dedup, near_duplicates, periodic_runs, quality, repeated_text, token_counts, token_files, toxicity
from sparkloom.llm._shared import fresh_path, small_batches, stored
from sparkloom.llm._text import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id with the number and digest of the ids of each text, and the digest of what they decode to."""
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    written = token_files.write(docs, fresh_path(spark, "token-files"), WORD_BPE)
    back = token_files.read_documents(token_files.read_index(spark, written), written)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id", *decontaminate.RESULT)


def op7_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repeated_text.report(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of the query starts a cache of its own, so it encodes its whole table; jobs pass the folder they keep."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, WORD_BPE)


#: A conversation whose texts hold the template's own control strings.
CONTROL_CASE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame(CONTROL_CASE, "conv_id bigint, turn bigint, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(*columns).unionByName(more)
    return chat_format.read_back(stored(chat_format.format_conversations(turns), "chat"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_echoes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.longest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read(spark, sf_dir, table) for table in ("documents", "benchmark"))
    return lexical_search.rank_documents(docs, items)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _bounded(f) for f in (op1_byte_bpe, op2_toxicity, op3_quality_rules, op4_token_files, op5_html_text, op6_decontamination, op7_repeated_text, op8_near_duplicates, op9_token_counts, op10_chat_format, op11_periodic_runs, op12_lexical_search, op13_line_dedup)}
