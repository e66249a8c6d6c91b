"""Exact repeated substrings by blockwise suffix sorting with a difference cover.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else in the corpus. The suffixes that matter are
the LENGTH-byte windows of all texts, and they are sorted one bucket at a time:

1. A window's bucket is the content of its anchor, the ANCHOR-byte string in it with the least hash (the leftmost of
   equals). The anchor depends on the window's bytes alone, so equal windows share a bucket, and they have the anchor
   at the same place. Successive windows with one anchor make an occurrence: a context of under 2 * LENGTH bytes.
2. Only buckets with two occurrences can hold repeats. Occurrences with equal contexts are repeats throughout. What is
   left are buckets with several different contexts; one of each is fetched.
3. A task takes such buckets in blocks of bounded size. In the block's text, the suffixes at a difference cover's
   positions (COVER modulo PERIOD) are ranked first, by doubling, to a depth of DEPTH bytes. A window then is compared by
   the rank at its first cover position, which resolves ties of any length, and by the LENGTH - DEPTH bytes that this
   rank leaves out. Contexts are laid out with their anchors at multiples of PERIOD, so windows to be compared have the
   same cover positions. Windows equal to a neighbour in sorted order are repeats.
4. A bucket with more than MAX_CONTEXTS contexts, such as the edge of a very common passage, is spread window by window:
   window digests are counted by a plain aggregation instead.

Where a context is repeated in the slice of rows at hand, it is settled there and sent on once, so that thousands of
copies don't meet in a task. Texts are shuffled compressed, once for contexts and once for the result.

Windows in contexts of one digest (64 bits of the anchor, 64 of the context) are taken as equal without a sort; most of
what copied documents repeat is found so, and the sort decides where contexts differ.

Defined cases: a null text counts as empty; rows without ids, and rows that share one, are told apart by their texts; texts under LENGTH bytes have nothing removed; a text's own repeats and
overlapping repeats count; rows that repeat are each other's copies; an empty table gives an empty result. remove()
keeps further columns and drops a character of which only some bytes are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm._shared import Scratch
from sparkloom.llm.quality import _schema

LENGTH = 200
ANCHOR = 48
PERIOD = 8
#: Every difference modulo 8 is one of two members.
COVER = (0, 1, 2, 4)
DEPTH = 192
MAX_CONTEXTS = 4096
BLOCK = 2 << 20
#: A longer text is searched in pieces of so many bytes.
PIECE = 1 << 20

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_A, _B = (int(x) | 1 for x in _rng.integers(1, 2**63, 2))
_LOW = np.uint64(0xFFFFFFFF)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from theirs."""
    h = x * np.uint64(_A) + (y ^ (y >> np.uint64(29))) * np.uint64(_B)
    return h ^ (h >> np.uint64(32))


def _double(h: np.ndarray, n: int) -> np.ndarray:
    return _join(h[:-n], h[n:]) if len(h) > n else h[:0]


class Occurrences:
    """For a slice: anchors with the windows [low, high] that have them, and hashes of anchor and context."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        none = np.zeros(0, np.int64)
        self.text = self.low = self.high = self.at = none
        self.anchor = self.context = none.astype(np.uint64)
        n = len(data)
        if n < LENGTH:
            return
        h1 = _BYTE[data]
        h2 = _double(h1, 1)
        h4 = _double(h2, 2)
        h8 = _double(h4, 4)
        del h1, h2, h4
        h16 = _double(h8, 8)
        h32 = _double(h16, 16)
        h48 = _join(h32[: n - ANCHOR + 1], h16[32 : n - ANCHOR + 33])
        del h16
        least = (h48 & ~_LOW) | np.arange(len(h48), dtype=np.uint64)
        size = 1
        span = LENGTH - ANCHOR + 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: n - LENGTH + 1], least[span - size : span - size + n - LENGTH + 1])
        inside = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(offsets) >= LENGTH)
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
        window = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
        if not len(window):
            return
        at = (least[window] & _LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        self.low = window[first]
        self.high = window[np.append(first[1:], len(window)) - 1]
        # Two texts that meet can't share an anchor: a window lies in one text.
        self.at = at[first]
        self.text = np.searchsorted(offsets, self.low, side="right") - 1
        self.anchor = h48[self.at]

        def window_hash(i: np.ndarray) -> np.ndarray:
            h = h32[i]
            for k in range(32, DEPTH, 32):
                h = _join(h, h32[i + k])
            return _join(h, h8[i + DEPTH])

        shape = ((self.high - self.low) << 32 | (self.at - self.low)).astype(np.uint64)
        self.context = tx.mix(_join(_join(window_hash(self.low), window_hash(self.high)), shape))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as disjoint spans that don't touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def row_key(key: int | None, text: bytes) -> tuple[int, int]:
    """Rows with one id and one text share it; rows with one id and different texts, or without ids, don't."""
    digest = hashlib.blake2b(text, digest_size=16).digest()
    high, low = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    return (high, low | 1) if key is None else (key, low & ~1)


def _row_keys(keys: list[int | None], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    made = np.array([row_key(k, data[a:b].tobytes()) for k, a, b in zip(keys, offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Data, offsets, rows and bases of runs of texts. A text over PIECE bytes comes alone, in overlapping pieces, so that
    every window is in one."""
    size = np.diff(offsets)
    plain = 0
    for r in [*np.flatnonzero(size > PIECE).tolist(), len(size)]:
        if r > plain:
            yield data[offsets[plain] : offsets[r]], offsets[plain : r + 1] - offsets[plain], np.arange(plain, r), np.zeros(r - plain, np.int64)
        if r < len(size):
            for s in range(0, int(size[r]) - LENGTH + 1, PIECE):
                part = data[offsets[r] + s : min(offsets[r + 1], offsets[r] + s + PIECE + LENGTH - 1)]
                yield part, np.array([0, len(part)]), np.array([r]), np.array([s])
        plain = r + 1


_OCCURRENCE = "rid bigint, tag bigint, low int, high int, at int, anchor bigint, context bigint, n int"


def _found_in(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, base: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    o = Occurrences(data, offsets)
    order = np.lexsort((o.context, o.anchor))
    new = np.ones(len(order), bool)
    new[1:] = (o.anchor[order][1:] != o.anchor[order][:-1]) | (o.context[order][1:] != o.context[order][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    chosen = order[first]
    again = order[np.repeat(count > 1, count)]
    shift = base[o.text] - offsets[:-1][o.text] if len(o.text) else o.low
    # Spans of different rows are kept apart by a gap when they are merged.
    gap = int(base.max(initial=0) + np.diff(offsets).max(initial=0)) + LENGTH + 2
    owner = row[o.text] if len(o.text) else o.low
    low, high = o.low + shift, o.high + shift
    start, end = merge(low[again] + owner[again] * gap, high[again] + LENGTH + owner[again] * gap)
    of = start // gap
    columns = [
        *(np.concatenate([k[owner[chosen]], k[of]]) for k in keys),
        np.concatenate([low[chosen], start - of * gap]).astype(np.int32),
        np.concatenate([high[chosen], end - of * gap]).astype(np.int32),
        np.concatenate([o.at[chosen] - o.low[chosen], np.zeros(len(of), np.int64)]).astype(np.int32),
    ]
    none = np.concatenate([np.zeros(len(chosen), bool), np.ones(len(of), bool)])
    hashes = [pa.array(np.concatenate([h[chosen].view(np.int64), np.zeros(len(of), np.int64)]), mask=none) for h in (o.anchor, o.context)]
    n = np.concatenate([count, np.ones(len(of), np.int64)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *hashes, pa.array(n)], names=["rid", "tag", "low", "high", "at", "anchor", "context", "n"])


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences (one of each context in a slice), and, with null anchors, spans settled in the slice."""
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                raw, places = tx.text_bytes(part.column("_text"))
                keys = _row_keys(part.column("_id").to_pylist(), raw, places)
                for piece in _pieces(raw, places):
                    yield _found_in(*piece, keys)

    return rows.mapInArrow(run, _OCCURRENCE)


def _packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs without text, with rid and the text compressed; columns of docs named so are taken along as _c0, _c1 ..."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)))
    names = [f"_c{i}" for i in range(len(kept))]
    schema = _schema(rows.select(*names), {"rid": "bigint", "tag": "bigint", "packed": "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                data, offsets = tx.text_bytes(part.column("_text"))
                rid, tag = _row_keys(part.column("_id").to_pylist(), data, offsets)
                packed = [pack.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rid), pa.array(tag), pa.array(packed, pa.binary())], names=[*names, "rid", "tag", "packed"])

    return rows.mapInArrow(run, schema)


_CONTEXT = "anchor bigint, n bigint, rid bigint, tag bigint, low int, at int, bytes binary"


def _contexts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted occurrences. A row's wishes are as many as its text is long, so they fit in a list."""
    lists = wanted.groupBy("rid", "tag").agg(F.collect_list(F.struct("anchor", "n", "low", "high", "at")).alias("wishes"))
    packed = _packed(docs.select(F.col(key).alias("_key"), F.col(text).alias("_body")), "_key", "_body").select("rid", "tag", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data = unpack.decompress(batch.column("packed")[i].as_py())
                w = batch.column("wishes")[i].values
                low, high = w.field("low").to_pylist(), w.field("high").to_pylist()
                size = len(low)
                bodies = pa.array([data[a : b + LENGTH] for a, b in zip(low, high, strict=True)], pa.binary())
                own = [pa.array([batch.column(c)[i].as_py()] * size, pa.int64()) for c in ("rid", "tag")]
                yield pa.RecordBatch.from_arrays([w.field("anchor"), w.field("n"), *own, w.field("low"), w.field("at"), bodies], names=["anchor", "n", "rid", "tag", "low", "at", "bytes"])

    return packed.join(lists, ["rid", "tag"]).select("rid", "tag", "packed", "wishes").mapInArrow(run, _CONTEXT)


def cover_ranks(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Ranks of the DEPTH-byte strings at the positions, which come in ascending order and hold, with each, those
    PERIOD further on as long as DEPTH bytes are left there; equal strings have equal ranks."""
    padded = np.concatenate([text, np.zeros(DEPTH + PERIOD, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, PERIOD)[positions]
    rank = np.unique(np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64), return_inverse=True)[1].astype(np.int64)
    size, halves = PERIOD, {}
    while size < DEPTH:
        halves[size] = rank
        step = size if size * 2 <= DEPTH else DEPTH - size
        other = rank if step == size else halves[step]
        next_at = np.minimum(np.searchsorted(positions, positions + size), len(positions) - 1)
        further = np.where(positions[next_at] == positions + size, other[next_at], -1)
        rank = np.unique(rank * (len(positions) + 1) + further + 1, return_inverse=True)[1].astype(np.int64)
        size += step
    return rank


def repeated_windows(bucket: np.ndarray, at: np.ndarray, bodies: list[bytes]) -> list[np.ndarray]:
    """For each context (bytes with its anchor at offset at, in a numbered bucket) the windows that another one has."""
    sizes = np.array([len(b) for b in bodies])
    lead = (-at) % PERIOD
    begin = np.cumsum(np.concatenate([[0], (-(-(lead + sizes + PERIOD) // PERIOD) * PERIOD)[:-1]])) + lead
    text = np.zeros(int(begin[-1] + sizes[-1]) + LENGTH, np.uint8)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    text[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    windows = sizes - LENGTH + 1
    own = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    i = begin[own] + nth
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    to_cover = np.array([next(d for d in range(PERIOD) if cover[(r + d) % PERIOD]) for r in range(PERIOD)])
    used = np.zeros(len(text), bool)
    used[flat_positions(begin, sizes)] = True
    positions = np.flatnonzero(used & cover[np.arange(len(text)) % PERIOD])
    rank = cover_ranks(text, positions)
    d = to_cover[i % PERIOD]
    rank = rank[np.searchsorted(positions, i + d)]
    left = np.arange(LENGTH - DEPTH)[None, :]
    rest_at = i[:, None] + np.where(left < d[:, None], left, left + DEPTH)
    rest = np.ascontiguousarray(text[rest_at]).view(">u8").ravel().astype(np.uint64)
    place = bucket[own] * LENGTH + (at[own] - nth)
    order = np.lexsort((rest, rank, place))
    same = (place[order][1:] == place[order][:-1]) & (rank[order][1:] == rank[order][:-1]) & (rest[order][1:] == rest[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.cumsum(windows)
    return [nth[a:b][twice[a:b]] for a, b in zip(ends - windows, ends, strict=True)]


def flat_positions(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _sorted_buckets(contexts: DataFrame) -> DataFrame:
    """Spans of repeats in buckets, which are taken in blocks of whole buckets of about BLOCK bytes."""

    def settle(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        number = np.cumsum([0] + [a[0] != b[0] for a, b in zip(block[1:], block, strict=False)])
        rid, tag, start, end = [], [], [], []
        found = repeated_windows(number, np.array([b[5] for b in block]), [b[6] for b in block])
        for (_, n, own, own_tag, low, _, _), windows in zip(block, found, strict=True):
            if n == 1 and len(windows):
                s, e = merge(windows + low, windows + low + LENGTH)
                rid += [own] * len(s)
                tag += [own_tag] * len(s)
                start += s.tolist()
                end += e.tolist()
        if rid:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (rid, tag)), *(pa.array(c, pa.int32()) for c in (start, end))], names=["rid", "tag", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[0] != block[-1][0]:
                    yield from settle(block)
                    block, size = [], 0
                block.append(row)
                size += len(row[6])
        if block:
            yield from settle(block)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "rid bigint, tag bigint, start int, end int")


def _spread_buckets(contexts: DataFrame, store: Scratch) -> DataFrame:
    """The same for buckets of any size: windows are counted by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for anchor, n, rid, tag, low, _, body in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    out += [(anchor, hashlib.blake2b(body[i : i + LENGTH], digest_size=16).digest(), n, rid, tag, low + i) for i in range(len(body) - LENGTH + 1)]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "window", "n", "rid", "tag", "start"])

    windows = store.table(contexts.mapInArrow(run, "anchor bigint, window binary, n bigint, rid bigint, tag bigint, start int"), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("k")).where("k > 1")
    return windows.where("n = 1").join(twice, ["anchor", "window"], "left_semi").select("rid", "tag", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """rid, tag and spans (start, end in bytes) to remove, which may overlap, for the rows that have any. A stored table."""
    with Scratch(docs.sparkSession) as store:
        all_found = store.table(_occurrences(docs, key, text), "occurrences")
        settled = store.table(all_found.where("anchor IS NULL").select("rid", "tag", F.col("low").alias("start"), F.col("high").alias("end")), "settled")
        found = all_found.where("anchor IS NOT NULL")
        often = found.groupBy("anchor").agg(F.sum("n").alias("k")).where("k > 1").select("anchor")
        shared = store.table(found.join(often, "anchor", "left_semi"), "shared")
        store.drop(all_found)
        first = F.min(F.struct("rid", "tag", "low", "high", "at")).alias("one")
        kinds = store.table(shared.groupBy("anchor", "context").agg(F.sum("n").alias("n"), first), "contexts")
        whole = shared.join(kinds.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("rid", "tag", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end"))
        whole = store.table(whole, "whole")
        several = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
        wanted = store.table(kinds.join(several, "anchor").select("anchor", "k", "n", "one.*"), "wanted")
        store.drop(shared, kinds)
        spans = settled.unionByName(whole).unionByName(_sorted_buckets(_contexts(docs, key, text, wanted.where(F.col("k") <= max_contexts))))
        hot = wanted.where(F.col("k") > max_contexts)
        if not hot.isEmpty():
            spans = spans.unionByName(_spread_buckets(_contexts(docs, key, text, hot), store))
        return store.table(spans.groupBy("rid", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans", keep=True)


REPORT = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept": "binary"}


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without text, with REPORT: bytes, bytes removed, maximal removed runs, and the bytes that stay."""
    columns = [c for c in docs.columns if c != text]
    clash = {c: f"_old_{c}" for c in columns if c in REPORT}
    names = [f"_c{i}" for i in range(len(columns))]
    rows = _packed(docs, key, text).join(repeated_spans(docs, key, text, **options), ["rid", "tag"], "left").drop("rid", "tag")
    kept = [f for f in rows.schema.fields if f.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for i in range(part.num_rows):
                    data = unpack.decompress(part.column("packed")[i].as_py())
                    spans = part.column("spans")[i]
                    start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if spans.is_valid:
                        start, end = merge(*(spans.values.field(c).to_numpy().astype(np.int64) for c in ("start", "end")))
                    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(data)]
                    stays = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    out.append((len(data), int((end - start).sum()), len(start), stays))
                values = list(zip(*out, strict=True)) or [[]] * 4
                arrays = [pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *arrays], names=[*names, *REPORT])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{k}` {v}" for k, v in REPORT.items()])
    return rows.mapInArrow(run, schema).withColumnsRenamed({n: clash.get(c, c) for n, c in zip(names, columns, strict=True)})


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the repeated bytes taken out of their texts, in the columns of docs."""
    made = report(docs, key, text, **options)
    body = F.try_validate_utf8(F.col("kept").cast("string"))
    # A cut can leave part of a character, which is dropped.
    cleaned = F.coalesce(body, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    return made.select(*(cleaned.alias(c) if c == text else F.col(f"_old_{c}").alias(c) if c in REPORT else F.col(c) for c in docs.columns))
