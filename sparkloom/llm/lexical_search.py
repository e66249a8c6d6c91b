"""Ranked lexical search: postings bucketed by term, joined to the terms of items, scored in whole numbers, summed and ranked.

``build_postings`` writes the index: a row for each term of each document with its occurrences, as a table bucketed and
sorted by term, and one row without a term for each document. Terms come out of a task that sees whole texts, so the rows of
a document need no aggregation; the one shuffle takes them to their buckets. A term's rows lie in PARTS parts by
document, so a term that every document has is not one key. An index for known items can be written with their terms alone.

``search`` ranks the documents for each item. Item terms are joined to the postings, counted, and weighed; the matched rows
are scored and taken to the documents (one shuffle, by document), where each meets the items that have its term and the
scores of an item and a document are summed where they are. The best of an item are cut in every task before they meet
(a window over row_number). Item terms, and their weights, are broadcast up to BROADCAST_TERMS rows; more are joined by term and
part, as the table is bucketed, and the weights by term.

Defined cases: null texts and texts without terms are no documents and no item terms, and don't count in N; items
without terms, or whose terms no document has, have no rows; equal scores rank by ascending key (null last), then by the
text's digest. Rows alike in key and text are one row of a result, but count as often as they occur in N, L and df; rows
that share a key and differ in text are ranked each on its own. Item rows that share an item key are one item of all
their terms. Tables may be empty. Further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm._shared import Scratch

TOP = 20
#: Parts that a term's rows are dealt over.
PARTS = 32
#: Up to so many rows of item terms are broadcast.
BROADCAST_TERMS = 200_000
PIECE_BYTES = 1 << 20

# The term's characters as bytes of UTF-8, and the bytes at which a text may be cut.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(tx.lower_table())


def count_terms(text: bytes) -> Counter:
    """Occurrences of each term of a text, which is scanned in pieces that end at the end of a term."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        stop = min(start + PIECE_BYTES, len(text))
        if stop < len(text) and (running := _TERM.match(text, stop)):
            stop = running.end()
        found.update(_TERM.findall(text[start:stop].translate(_LOWER)))
        start = stop
    return found


def _terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _row, term, tf and n of every term of every text, and a row without a term (tf = n) for each text. No shuffle."""
    digest = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.hash(text))  # rows without a key have more to tell apart
    source = rows.select(F.col(key).alias("_key"), digest.cast("bigint").alias("_row"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                sizes, terms, tf, n = [], [], [], []
                for value in part.column("_text").cast(pa.large_binary()):
                    found = count_terms(value.as_py() or b"")
                    sizes.append(len(found) + 1 if found else 0)
                    if found:
                        terms += [None, *found]
                        tf += [found.total(), *found.values()]
                        n.append(found.total())
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                n = pa.array(np.repeat(np.array(n, np.int64), [x for x in sizes if x]))
                yield pa.RecordBatch.from_arrays([part.column("_key").take(at), part.column("_row").take(at), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), n], names=["_key", "_row", "term", "tf", "n"])

    return source.mapInArrow(run, f"_key {kind}, _row bigint, term string, tf bigint, n bigint")


def build_postings(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", only: DataFrame | None = None, buckets: int | None = None) -> str:
    """Writes the postings of docs to path, a folder that all machines share, as a table bucketed by term and part; its name.

    only: a table with the distinct terms that matter; rows of other terms are not written. buckets: as many as the session has
    shuffle partitions, if not given, so that each task writes one file.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = f"postings_{uuid.uuid4().hex}"
    postings = _terms(docs, key, text).withColumn("part", F.pmod("_row", F.lit(PARTS)).cast("int"))
    if only is not None:
        # The rows of documents have no term; they pass with a term that no text can have.
        chosen = only.select("term").unionByName(docs.sparkSession.sql("SELECT '' AS term"))
        postings = _at_terms(postings.withColumn("term", F.coalesce("term", F.lit(""))), chosen, "left_semi").withColumn("term", F.nullif("term", F.lit("")))
    dealt = postings.repartition(buckets, "term", "part")
    dealt.write.bucketBy(buckets, "term", "part").sortBy("term", "part").option("path", path).saveAsTable(name)
    return name


def _at_terms(postings: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """The postings of the terms (distinct)."""
    if terms.count() <= BROADCAST_TERMS:
        return postings.join(F.broadcast(terms), "term", how)
    return postings.join(terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["term", "part"], how)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term and how often the item has it."""
    return _terms(items, key, text).where("term IS NOT NULL").groupBy(F.col("_key").alias("item"), "term").agg(F.sum("tf").alias("times"))


def search(postings: DataFrame, wanted: DataFrame, store: Scratch, top: int = TOP) -> DataFrame:
    """postings as written by build_postings, wanted as made by item_terms: item, rank, _key, score."""
    totals = postings.where("term IS NULL").agg(F.count("*").alias("N"), F.coalesce(F.sum("tf"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = F.lit(totals["N"]).cast("bigint"), F.lit(totals["L"]).cast("bigint")
    matched = _at_terms(postings, wanted.select("term").distinct(), "inner")

    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = matched.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w"))
    terms = store.table(wanted.join(weights, "term").select("item", "term", (F.col("times") * F.col("w")).alias("w")), "weighted-terms")

    m = 100 - 25 + _div(25 * F.col("n") * n_docs, n_terms)
    share = _div(1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 12 * m)
    placed = matched.select("_key", "_row", "term", share.alias("share")).repartition("_key", "_row")
    once = placed.groupBy("_key", "_row", "term").agg(F.first("share").alias("share"))
    scores = once.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term").groupBy("item", "_key", "_row").agg(F.sum(F.col("w") * F.col("share")).alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_key"), F.asc("_row"))
    ranked = scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item", "rank", "_key", "score")


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """For each item its highest-scoring documents: item key, rank, key, score. The index goes when the result is written."""
    spark = docs.sparkSession
    with Scratch(spark) as store:
        wanted = store.table(item_terms(items, item_key, text), "item-terms")
        name = build_postings(docs, store.path("postings"), key, text, wanted.select("term").distinct())
        try:
            ranked = search(spark.table(name), wanted, store, top)
            made = store.table(ranked.select(F.col("item").alias(item_key), "rank", F.col("_key").alias(key), "score"), "ranked", keep=True)
        finally:
            spark.sql(f"DROP TABLE {name}")
    return made
