"""Line dedup: lines that many documents share stay only in the document with the greatest key. DataFrame functions only.

A line's key is the line without white space at its ends, in lower case; only its 128-bit hash travels. The lines of all texts
are range-partitioned by hash and slice of documents, with a secondary sort by document (falling) and position. A stream over that
order marks where a document begins within a hash, so the first row of a hash and slice is its first occurrence.
A hash that a third of all documents hold is cut into SLICES slices, which sum up to counts and the greatest key by partial
aggregation. What is dropped meets by document as bits of its line numbers: ``keep_bitmaps`` returns them, words of 64 lines,
without the words of which every line stays. Texts don't move for it; ``apply_bitmaps`` brings the two together.

Defined cases: null and empty texts are one empty line; keys under MIN_CHARS code points are never dropped, so neither are empty
lines; a document is what has one doc_id, so of rows that share a doc_id all keep the lines of which it is the greatest
holder, and they count once; rows without a doc_id are documents by their text, and count as smaller than any doc_id: they lose what
a row with a doc_id holds, and lose nothing where only such rows hold it. Repeated rows have equal results. Tables may be empty.
Further columns pass through apply_bitmaps, except that its own columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.llm._shared import Scratch

MIN_CHARS, MIN_DOCS = 40, 5
#: Slices of documents that one hash is cut into.
SLICES = 32
#: Bitmaps of up to so many words of 64 lines and rows are broadcast; more are joined by shuffle.
BROADCAST_WORDS = 1_000_000

# The white space that is stripped, and the letters that are lowered.
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(key: str, text: str) -> list[Column]:
    """A row by its key and text: two hashes, which rows alike share."""
    return [F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias(name) for seed, name in ((1, "_r1"), (2, "_r2"))]


def ordered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """_h1, _h2 of every long line with its document, position and whether the document begins there within the hash and slice."""
    rows = docs.select(F.col(key).alias("_key"), *_row(key, text), F.posexplode(_lines(F.col(text))).alias("_pos", "_line"))
    lines = rows.withColumn("_line", F.btrim("_line", F.lit(_WHITE))).where(F.length("_line") >= min_chars)
    lowered = F.translate("_line", _UPPER, _LOWER)
    slice_of = F.pmod(F.when(F.col("_key").isNull(), F.col("_r1")).otherwise(F.xxhash64("_key")), F.lit(SLICES)).cast("int")
    hashed = lines.select(F.xxhash64(F.lit(3), lowered).alias("_h1"), F.xxhash64(F.lit(4), lowered).alias("_h2"), slice_of.alias("_slice"), "_key", "_r1", "_r2", "_pos")
    ranged = hashed.repartitionByRange("_h1", "_h2", "_slice")
    stream = Window.partitionBy("_h1", "_h2", "_slice").orderBy(F.desc_nulls_last("_key"), F.asc("_r1"), F.asc("_r2"), F.asc("_pos"))
    document = F.struct("_key", F.when(F.col("_key").isNull(), F.struct("_r1", "_r2")).alias("_row"))
    return ranged.withColumn("_begins", ~F.lag(document).over(stream).eqNullSafe(document))


def keep_bitmaps(docs: DataFrame, store: Scratch, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """A stored table of the rows that lose lines: _r1, _r2 (hashes of key and text), n_dropped, and bits of the dropped lines.

    dropped holds pairs (word, bits) by word: bit i of bits is line 64 * word + i. Lines of words that aren't there stay.
    """
    lines = store.table(ordered_lines(docs, key, text, min_chars), "lines")
    shared = lines.groupBy("_h1", "_h2").agg(F.count_if("_begins").alias("_n"), F.max("_key").alias("_top")).where(F.col("_n") >= min_docs)
    shared = store.table(shared.drop("_n"), "shared-lines")
    lost = lines.join(shared, ["_h1", "_h2"]).where(~F.col("_key").eqNullSafe(F.col("_top")))
    bit = F.expr("shiftleft(1L, _pos % 64)")
    words = lost.groupBy("_r1", "_r2", F.floor(F.col("_pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = words.groupBy("_r1", "_r2").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).alias("n_dropped"))
    made = store.table(packed, "bitmaps", keep=True)
    store.drop(lines, shared)
    return made


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped, the bitmap of dropped lines, and kept: the lines that stay, joined by line feeds."""
    # All words up to the last with a dropped line, so that a line finds its bits by position.
    gap = lambda x, i: x["word"] - F.coalesce(F.get(F.col("dropped"), i - 1)["word"], F.lit(-1)) - 1
    dense = F.flatten(F.transform("dropped", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), gap(x, i)), F.array(x["bits"]))))
    marks = bitmaps.select("_r1", "_r2", "n_dropped", "dropped", dense.alias("_bits"))
    size = bitmaps.agg(F.coalesce(F.sum(F.get("dropped", F.size("dropped") - 1)["word"] + 2), F.lit(0))).first()[0]
    rows = docs.drop("n_lines", "n_dropped", "dropped", "kept").withColumns({c: r for c, r in zip(("_r1", "_r2"), _row(key, text), strict=True)})
    joined = rows.join(F.broadcast(marks) if size <= BROADCAST_WORDS else marks, ["_r1", "_r2"], "left")
    bit = lambda i: F.coalesce(F.get(F.col("_bits"), F.floor(i / 64).cast("int")), F.lit(0))
    stays = F.filter(_lines(F.col(text)), lambda line, i: F.call_function("shiftright", bit(i), i % 64) % 2 == 0)
    return joined.withColumns(
        {
            "n_lines": F.size(_lines(F.col(text))).cast("bigint"),
            "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("bigint"),
            "kept": F.when(F.col("_bits").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stays, "\n")),
        }
    ).drop("_r1", "_r2", "_bits")


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without the lines that at least min_docs documents share, which stay in the one with the greatest key."""
    with Scratch(docs.sparkSession) as store:
        bitmaps = keep_bitmaps(docs, store, key, text, min_chars, min_docs)
    return apply_bitmaps(docs, bitmaps, key, text)
