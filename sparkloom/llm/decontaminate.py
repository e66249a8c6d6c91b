"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is the words of a text; a pattern is one window of a benchmark item. For each pattern length there is a
shift table over blocks of two successive words: it tells how far a search may jump because no pattern ends, within
that distance, with the block. Where the shift is zero, the block's suffix bucket names the windows that end with it,
and those are compared word by word, first by hash, then by their bytes.

A benchmark of one block (BLOCK_BYTES of text) is searched in one pass over the documents, without a shuffle. A larger one
is dealt into blocks by a Spark job; each block is a pass of its own over the documents, a Spark job that writes what it
finds, so a task holds one block's tables at a time. What the passes found meets by the digests of the texts, as equal
texts have equal hits. Tasks read their block from the shared folder; the driver holds no item.

Defined cases: null texts and items have no words; empty tables give no hits; a null item_id counts as the empty
string; repeated item rows count once; an item longer than a block is a block of its own; further columns pass through,
replaced where names clash with the result's.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm._shared import Scratch
from sparkloom.llm.quality import _schema, _with_columns

WINDOW = 10
BLOCK_BYTES = 4 << 20
LANE = 512
#: Up to so many digests of texts with hits are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_SPLIT = tx.separator_table(tx.NOT_ALNUM)
_LOWER = tx.lower_table()


class LengthTables:
    """Shift table and suffix buckets of all windows of one length, as first words of windows in the block's words."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, length: int):
        self.length, self.begin = length, begin
        self.block = min(2, length)
        ends = [begin + j for j in range(self.block - 1, length)]
        self.mask = np.uint64((1 << (int(np.ceil(np.log2(len(np.unique(np.concatenate(ends))) + 1))) + 4)) - 1)
        self.shift = np.full(int(self.mask) + 1, length - self.block + 1, np.uint8 if length < 256 else np.int32)
        for j, end in enumerate(ends):
            np.minimum.at(self.shift, self.key(hashes, end), self.shift.dtype.type(length - self.block - j))
        suffix = self.key(hashes, begin + length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def key(self, hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
        mixed = hashes[end] if self.block == 1 else tx.mix(hashes[end] + (hashes[end - 1] << np.uint64(1)))
        return (mixed & self.mask).astype(np.int64)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Ends of windows whose last block has shift 0. All lanes of the slice jump at once."""
        low, high = first[:-1] + self.length - 1, first[1:]
        lanes = np.maximum(0, -(-(high - low) // LANE))
        text = np.repeat(np.arange(len(low)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = low[text] + nth * LANE
        stop = np.minimum(at + LANE, high[text])
        found = []
        while len(at):
            jump = self.shift[self.key(hashes, at)].astype(np.int64)
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Patterns:
    """The windows of one block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        rows = list(dict.fromkeys((item, text) for item, text in items if text))
        self.ids = [item for item, _ in rows]
        raw = [text.encode() for _, text in rows]
        self.data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        self.words = tx.Words(self.data, np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64), _SPLIT)
        self.hashes = tx.span_hashes(self.data, self.words.start, self.words.end)
        self.item = self.words.text_of()
        n, first = self.words.per_text, self.words.first
        begins: dict[int, list[np.ndarray]] = {}
        for i in np.flatnonzero(n > 0).tolist():
            begins.setdefault(min(window, int(n[i])), []).append(np.arange(first[i], max(first[i], first[i + 1] - window) + 1))
        self.tables = [LengthTables(self.hashes, np.concatenate(b), length) for length, b in begins.items()]

    def word(self, i: int) -> bytes:
        return self.data[self.words.start[i] : self.words.end[i]].tobytes()

    def occurrences(self, table: LengthTables, hashes: np.ndarray, first: np.ndarray, word: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the item) of each occurrence of each window."""
        end = table.candidates(hashes, first)
        key = table.key(hashes, end)
        low, high = np.searchsorted(table.suffix, key), np.searchsorted(table.suffix, key, side="right")
        size = high - low
        begin = np.repeat(end - table.length + 1, size)
        inside = np.arange(len(begin)) - np.repeat(np.cumsum(size) - size, size)
        window = table.begin[table.order[np.repeat(low, size) + inside]]
        for j in range(table.length):
            same = hashes[begin + j] == self.hashes[window + j]
            begin, window = begin[same], window[same]
        exact = np.array([all(word(b + j) == self.word(w + j) for j in range(table.length)) for b, w in zip(begin.tolist(), window.tolist(), strict=True)], bool)
        return begin[exact], self.item[window[exact]]


RESULT = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}


def _search(rows: pa.RecordBatch, text: str, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """First word of each text, whether each word is hit, and the items found in each text."""
    raw, offsets = tx.text_bytes(rows.column(text))
    data = _LOWER[raw]
    scan = tx.Words(data, offsets, _SPLIT)
    hashes = tx.span_hashes(data, scan.start, scan.end)
    hit = np.zeros(len(hashes) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(rows.num_rows)]
    for table in patterns.tables:
        begin, item = patterns.occurrences(table, hashes, scan.first, lambda i: data[scan.start[i] : scan.end[i]].tobytes())
        np.add.at(hit, begin, 1)
        np.add.at(hit, begin + table.length, -1)
        text_of = np.searchsorted(scan.first, begin, side="right") - 1
        for t, i in set(zip(text_of.tolist(), item.tolist(), strict=True)):
            found[t].add(patterns.ids[i])
    return scan.first, np.cumsum(hit)[:-1] > 0, found


def _result(n_words: list[int], n_hit: list[int], items: list[set[str]]) -> dict[str, pa.Array]:
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array(digest, pa.string()),
        "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_()),
    }


@functools.lru_cache(maxsize=1)
def _patterns(path: str, block: int, window: int) -> Patterns:
    """The tables of one block, which a worker process keeps until it is given another block."""
    fs, root = pa.fs.FileSystem.from_uri(path)
    there = fs.get_file_info(f"{root}/block={block}")
    if there.type == pa.fs.FileType.NotFound:
        return Patterns([], window)
    rows = pa.parquet.read_table(f"{root}/block={block}", filesystem=fs, partitioning=None)
    return Patterns(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), window)


def _deal(benchmark: DataFrame, path: str, block_bytes: int) -> int:
    """Writes the items to path, by blocks of about block_bytes; the number of blocks. Rows of one item share a block."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    rows.distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
    return n


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with RESULT, for every row: words, words inside occurrences of item windows, and the items found."""
    with Scratch(docs.sparkSession) as store:
        path = store.path("benchmark", keep=True)
        n = _deal(benchmark, path, block_bytes)
        if n == 1:
            return _one_pass(docs.drop(*RESULT), path, text, window)
        hits = store.table(_all_hits(docs.select(F.col(text).alias("text")), path, n, window, store), "hits", keep=True)
    return _with_hits(docs.drop(*RESULT), hits, text)


def _one_pass(docs: DataFrame, path: str, text: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, text):
                first, inside, items = _search(rows, text, _patterns(path, 0, window))
                yield _with_columns(rows, _result(np.diff(first).tolist(), tx.per_text_sum(inside, first).tolist(), items))

    return docs.mapInArrow(run, _schema(docs, RESULT))


def _digest(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


_HITS = "_digest binary, bits binary, items array<string>"


def _all_hits(texts: DataFrame, path: str, n: int, window: int, store: Scratch) -> DataFrame:
    """Digests of the texts with hits, the numbers of words hit, and the items, over all blocks."""
    rows = texts.where("text <> ''").select(_digest(F.col("text")).alias("_digest"), "text")

    def search(block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.slices(batch, "text"):
                    first, inside, items = _search(part, "text", _patterns(path, block, window))
                    at = [i for i, x in enumerate(items) if x]
                    bits = [np.packbits(inside[first[i] : first[i + 1]]).tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays([part.column("_digest").take(pa.array(at, pa.int64())), pa.array(bits, pa.binary()), pa.array([sorted(items[i]) for i in at], pa.list_(pa.string()))], names=["_digest", "bits", "items"])

        return rows.mapInArrow(run, _HITS).groupBy("_digest").agg(F.first("bits").alias("bits"), F.first("items").alias("items"))

    found = [store.table(search(block), "block-hits") for block in range(n)]
    together = functools.reduce(DataFrame.unionByName, found).groupBy("_digest").agg(F.collect_list("bits").alias("bits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in bits])).sum()) for bits in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_digest"), pa.array(hit, pa.int64()), batch.column("items")], names=["_digest", "_n_hit", "_items"])

    return together.mapInArrow(count, "_digest binary, _n_hit bigint, _items array<string>")


def _with_hits(docs: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    body = F.col(names[docs.columns.index(text)])
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    rows = rows.join(hits, _digest(body) == F.col("_digest"), "left")
    words = F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint")
    items = F.coalesce(F.array_sort("_items"), F.array().cast("array<string>"))
    n_hit = F.coalesce("_n_hit", F.lit(0)).cast("bigint")
    made = rows.select(*names, words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    return made.toDF(*docs.columns, *RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs."""
    names = {c: f"_kept_{c}" for c in docs.columns if c in RESULT}
    marked = find_contamination(docs.withColumnsRenamed(names), benchmark, text, window, block_bytes)
    clean = marked.where(~F.col("contaminated")).drop(*RESULT)
    return clean.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)
