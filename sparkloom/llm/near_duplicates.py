"""Near-duplicates by order MinHash, with candidates verified by banded alignment.

Each text is a sequence of five-word k-mers; the n-th occurrence of a k-mer in a text is another element than its first.
For each of SKETCHES hash functions (short texts have more) a sketch takes the MINIMA elements with the least hashes and hashes them in the order
in which they stand in the text, so it is sensitive to order as edit distance is. Texts that share a sketch are
candidates. Texts of few words have too few k-mers for that: a text under BRIEF words is cut into one segment more than the edits that a link
to it may have, so that one segment at least stands in the other text, moved by few words; the segments of the shorter and
what stands there in the longer are sketches too, and find every link of such a text. A link holds if the edit distance of their word sequences, found within a band, is at most (1 - similarity)
of the longer one's length.

Nodes are the distinct texts with words, numbered as they are stored; sketches, links and components are theirs, ids come
back at the end. The leader of a bucket is its least node; each text is first compared to the leader that it shares most
buckets with, which settles most buckets with one comparison a text and decides nothing by itself. Then all pairs of a bucket whose ends are still in different
components are compared: by block against block of at most about BLOCK texts a side, where pairs are passed over only if
their lengths or their bags of words rule a link out, and those that are left are aligned unless links have joined them in the
meantime. The largest component of a bucket is met in blocks of its own, once for all its buckets. So no pair that shares a sketch is left out, and classes are the components of all links between such texts. Buckets only exist as rows, joined by
their keys, so a bucket of any size is spread.

Defined cases: null and empty texts, and texts without words, are classes of their own; texts under five words count as
one k-mer; equal texts share a class, whatever their ids; the class id is the least id of the class that isn't null, or
null if there is none; an empty table gives an empty result; further columns are ignored by classes() and kept by
deduplicate(), which keeps one row of each class: that with the class id and, of texts under that id, the least digest
(null ids: one row of the least digest). Rows without words all stay. Rows that repeat both id and text can't be told
apart and stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm._shared import Scratch
from sparkloom.llm.components import joined_components, linked_components

K = 5
SKETCHES = 96
#: Texts under SHORT words have more sketches, as chance weighs more where there are few k-mers.
SHORT, MORE_SKETCHES = 100, 64
MINIMA = 2
#: Texts under BRIEF words are found by segments.
BRIEF = 30
SIMILARITY = 0.8
BLOCK = 512
#: Up to so many rows of nodes are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bins of the bag of words that stands for a text while pairs are passed over.
BINS = 1024
#: Edits up to which diagonals are followed.
FEW = 8
_STEP = np.arange(32)

_WHITE = tx.separator_table(tx.WHITE)
_LOWER = tx.lower_table()
_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = np.uint64(2**64 - 1)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    low = _LOWER[data]
    scan = tx.Words(low, offsets, _WHITE)
    return scan, tx.span_hashes(low, scan.start, scan.end)


def elements(scan: tx.Words, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the occurrence-labelled k-mers, first k-mer of each text); short texts are one k-mer."""
    at, gram = tx.grams(words, scan.first, k)
    text = scan.text_of()[at] if len(at) else at
    short = np.flatnonzero((scan.per_text > 0) & (scan.per_text < k))
    if len(short):
        whole = np.array([tx.mix(np.array([np.dot(words[scan.first[t] : scan.first[t + 1]], _PLACE[: scan.per_text[t]]) ^ np.uint64(scan.per_text[t])], np.uint64))[0] for t in short], np.uint64)
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        gram, text = np.concatenate([gram, whole])[order], np.concatenate([text, short])[order]
    order = np.lexsort((gram, text))
    same = np.zeros(len(order), bool)
    same[1:] = (gram[order][1:] == gram[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.flatnonzero(~same)
    nth = np.zeros(len(order), np.uint64)
    nth[order] = (np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))).astype(np.uint64)
    return tx.mix(gram + nth * _PLACE[63]), np.searchsorted(text, np.arange(len(scan.per_text) + 1))


def sketches(labelled: np.ndarray, first: np.ndarray, n: int, minima: int, start: int = 0) -> np.ndarray:
    """One row for each text, n sketches each by the hash functions from start; texts without k-mers have zeros.

    Only elements under a limit, which about 4 * minima of a text pass, are looked at closely; a text of which too few
    pass under some hash function is done again with all its elements.
    """
    size = np.diff(first)
    out = np.zeros((len(size), n), np.uint64)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return out
    own = size[full]
    share = np.minimum(1.0, 4 * minima / own)
    limit = np.where(share < 1, (share * 2.0**63).astype(np.uint64) * np.uint64(2), _MOST)
    text, limits = np.repeat(np.arange(len(full)), own), np.repeat(limit, own)
    least_many = np.minimum(own, minima)
    for j in range(start, start + n):
        hashed = labelled * _MULTIPLY[j]
        near = np.flatnonzero(hashed <= limits)
        begin = np.searchsorted(text[near], np.arange(len(full) + 1))
        places = np.full((len(full), minima), np.iinfo(np.int64).max)
        enough = np.diff(begin) >= least_many
        if enough.all():
            places[:] = _least_places(hashed[near], near, begin, minima)
        else:
            good, poor = np.flatnonzero(enough), np.flatnonzero(~enough)
            some = enough[text[near]]
            places[good] = _least_places(hashed[near][some], near[some], np.append(0, np.cumsum(np.diff(begin)[good])), minima)
            for t in poor:
                all_of = np.arange(first[full[t]], first[full[t] + 1])
                places[t] = _least_places(hashed[all_of], all_of, np.array([0, len(all_of)]), minima)[0]
        places.sort(axis=1)
        value = np.full(len(full), np.uint64(j + 1))
        for i in range(minima):
            there = places[:, i] < len(labelled)
            value = tx.mix(value * _PLACE[i] + np.where(there, labelled[np.minimum(places[:, i], len(labelled) - 1)], np.uint64(0)))
        out[full, j - start] = value
    return out


def all_sketches(labelled: np.ndarray, first: np.ndarray, n: int, minima: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of the texts one after another, and where each text's begin: n, and more for those under SHORT words."""
    made = sketches(labelled, first, n, minima)
    short = np.flatnonzero(np.diff(first) < SHORT - K + 1)
    if not len(short) or not more:
        return made.ravel(), np.arange(len(made) + 1) * n
    own = np.concatenate([np.arange(first[t], first[t + 1]) for t in short])
    others = sketches(labelled[own], np.append(0, np.cumsum(np.diff(first)[short])), more, minima, n)
    count = np.full(len(made), n)
    count[short] += more
    begin = np.append(0, np.cumsum(count))
    out = np.empty(begin[-1], np.uint64)
    out[begin[:-1][:, None] + np.arange(n)] = made
    out[begin[:-1][short][:, None] + n + np.arange(more)] = others
    return out, begin


def edits(words: int, similarity: float) -> int:
    """How many edits a link may have whose longer text has so many words."""
    return int((1 - similarity) * words + 1e-9)


def segments(words: np.ndarray, similarity: float) -> set[int]:
    """Hashes of the segments by which a text under BRIEF words, of so many word hashes, is found, and of where those of shorter ones may stand in it.

    A segment may have moved by no more words than the edits before it and after it leave, and where more edits than segments
    lie on one side of it, some segment of the other side is whole.
    """
    m, found = len(words), set()

    def cut(length: int) -> list[tuple[int, int]]:
        most = max(edits(n, similarity) for n in range(length, int(length / similarity + 1e-9) + 1))
        parts = min(length, most + 1)
        return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]

    def add(length: int, i: int, a: int, z: int) -> None:
        h = int(np.dot(words[a:z], _PLACE[: z - a]))
        found.add(int(tx.mix(np.array([h ^ (length << 56) ^ (i << 48)], np.uint64))[0]))

    for length in range(max(1, m - edits(m, similarity)), min(m, BRIEF - 1) + 1):
        most, longer, parts = edits(m, similarity), m - length, cut(length)
        for i, (a, z) in enumerate(parts):
            for moved in range(-min(i, most), min(i, most) + 1):
                rest = abs(longer - moved)
                if abs(moved) + rest <= most and rest < len(parts) - i and 0 <= a + moved and z + moved <= m:
                    add(length, i, a + moved, z + moved)
    return found


def _least_places(hashed: np.ndarray, place: np.ndarray, begin: np.ndarray, minima: int) -> np.ndarray:
    """Places of the least hashes of each run begin[i]:begin[i + 1], none of which is empty."""
    size = np.diff(begin)
    places = np.full((len(size), minima), np.iinfo(np.int64).max)
    if not len(size):
        return places
    hashed = hashed.copy()
    run = np.repeat(np.arange(len(size)), size)
    for i in range(minima):
        at = np.flatnonzero(hashed == np.minimum.reduceat(hashed, begin[:-1])[run])
        keep = size[run[at]] > i
        places[run[at[keep]], i] = place[at[keep]]
        hashed[at] = _MOST
    return places


def distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Whether the edit distance of two sequences is at most limit, by alignment within a band of limit diagonals a side.

    What both begin and end with is taken off, and word counts may rule a short distance out. Up to FEW edits the furthest
    reach on each diagonal is followed (Ukkonen); beyond, the band is gone through column by column, with the differences
    of neighbouring cells as bits of whole numbers (Hyyroe).
    """
    if abs(len(a) - len(b)) > limit:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if not n:
        return max(len(a), len(b)) <= limit
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b) or max(len(a), len(b)) <= limit:
        return max(len(a), len(b)) <= limit
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    in_a = np.zeros(len(values), np.int64)
    np.add.at(in_a, np.searchsorted(values, a), 1)
    if max(len(a), len(b)) - int(np.minimum(in_a, counts - in_a).sum()) > limit:
        return False
    if _few_edits(a, b, min(limit, FEW)):
        return True
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return limit > FEW and _within_band(longer.tolist(), shorter.tolist(), limit)


def _few_edits(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    goal = len(a) - len(b)
    left = np.concatenate([a.astype(np.int64), np.full(len(_STEP), -1)])
    right = np.concatenate([b.astype(np.int64), np.full(len(_STEP), -2)])
    middle = limit + 1
    reach = np.full(2 * limit + 3, -10, np.int64)
    diagonals = np.arange(-limit - 1, limit + 2)
    for edits in range(limit + 1):
        low, high = middle - edits, middle + edits + 1
        band = diagonals[low:high]
        if edits == 0:
            at = np.zeros(1, np.int64)
        else:
            at = np.maximum(np.maximum(reach[low:high] + 1, reach[low - 1 : high - 1] + 1), reach[low + 1 : high + 1])
        at = np.minimum(np.minimum(at, len(a)), len(b) + band)
        live = np.flatnonzero((at >= 0) & (at - band >= 0))
        while len(live):
            here = at[live][:, None] + _STEP
            same = left[here] == right[here - band[live][:, None]]
            run = np.where(same.all(axis=1), len(_STEP), same.argmin(axis=1))
            at[live] += run
            live = live[run == len(_STEP)]
        reach[low:high] = at
        if abs(goal) <= edits and reach[middle + goal] >= len(a):
            return True
    return False


def _within_band(a: list[int], b: list[int], limit: int) -> bool:
    """Bit i of a column's numbers is row column - limit + i of the table, rows being words of a and columns of b.

    The distance is followed down the lowest diagonal of the band to the last row, then along that row. a is the longer
    one, and longer than limit.
    """
    rows, columns, width = len(a), len(b), 2 * limit + 1
    where: dict[int, list[int]] = {}
    for i, word in enumerate(a):
        where.setdefault(word, []).append(i)
    places = {word: sum(1 << i for i in at) for word, at in where.items()}
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    more, less, distance = full ^ ((1 << limit) - 1), 0, limit
    down = rows - limit
    can_fall = columns - down
    for column, word in enumerate(b):
        equal = places.get(word, 0)
        equal = (equal >> (column - limit) if column >= limit else equal << (limit - column)) & full
        same = ((((equal & more) + more) ^ more) | equal | less) & full
        right_more, right_less = less | (full ^ (same | more)), same & more
        if column < down:
            if not same & lowest:
                distance += 1
                if distance - can_fall > limit:
                    return False
        else:
            at = 1 << (width - 2 - (column - down))
            distance += bool(right_more & at) - bool(right_less & at)
        more, less = right_less | (full ^ ((same >> 1) | right_more)), (same >> 1) & right_more
    return distance <= limit


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and distance_within(a, b, int((1 - similarity) * longer + 1e-9))


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("_id"), _digest(F.col(text)).alias("_digest"), F.col(text).alias("_text"))


def _with_segments(made: np.ndarray, begin: np.ndarray, scan: tx.Words, words: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Sketches and where each text's begin, with the segments of texts of few words."""
    few = np.flatnonzero((scan.per_text > 0) & (scan.per_text <= int((BRIEF - 1) / similarity + 1e-9)))
    own = [np.array(sorted(segments(words[scan.first[t] : scan.first[t + 1]], similarity)), np.uint64) for t in few]
    count = np.zeros(len(begin), np.int64)
    count[few + 1] = [len(x) for x in own]
    values = np.concatenate([made[:0], *own])
    return np.insert(made, np.repeat(begin[few + 1], count[few + 1]), values), begin + np.cumsum(count)


def _sketched(rows: DataFrame, n: int, minima: int, k: int, more: int, similarity: float) -> DataFrame:
    """Digest, id, length and sketches of the rows that have words; of equal texts in a slice only the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                ids, count = {}, {}
                for at, (digest, own) in enumerate(zip(part.column("_digest").to_pylist(), part.column("_id").to_pylist(), strict=True)):
                    before = ids.get(digest)
                    count[digest] = count.get(digest, 0) + 1
                    if before is None:
                        ids[digest] = (own, at)
                    elif own is not None and (before[0] is None or own < before[0]):
                        ids[digest] = (own, before[1])
                rows = part.take(pa.array([at for _, at in ids.values()], pa.int64()))
                data, offsets = tx.text_bytes(rows.column("_text"))
                scan, words = hashed_words(data, offsets)
                made, begin = _with_segments(*all_sketches(*elements(scan, words, k), n, minima, more), scan, words, similarity)
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(made.view(np.int64)))
                columns = [rows.column("_digest"), pa.array([own for own, _ in ids.values()], pa.int64()), pa.array([count[d] for d in ids], pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["_digest", "_id", "_count", "_sketches"]).filter(pa.array(scan.per_text > 0))

    return rows.mapInArrow(run, "_digest binary, _id bigint, _count bigint, _sketches array<bigint>")


def _sequences(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and compressed word hashes of the texts of nodes(node, _digest, _id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        names = [n for n in batch_names if n != "_text"]
        for batch in batches:
            for part in tx.slices(batch, "_text"):
                data, offsets = tx.text_bytes(part.column("_text"))
                scan, words = hashed_words(data, offsets)
                words = (words >> np.uint64(33)).astype("<u4")
                packed = [pack.compress(words[a:b].tobytes()) for a, b in zip(scan.first[:-1], scan.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scan.per_text.astype(np.int64)), pa.array(packed, pa.binary())], names=[*names, "n", "words"])

    of_node = (rows["_digest"] == nodes["_digest"]) & rows["_id"].eqNullSafe(nodes["_id"])
    if nodes.count() <= BROADCAST_ROWS:
        batch_names = ["node", "_text"]
        made = rows.join(F.broadcast(nodes), of_node).select("node", "_text").mapInArrow(run, "node bigint, n bigint, words binary")
    else:
        batch_names = ["_id", "_digest", "_text"]
        rows = rows.select("_id", "_digest", "_text").mapInArrow(run, "_id bigint, _digest binary, n bigint, words binary")
        made = rows.join(nodes, (rows["_digest"] == nodes["_digest"]) & rows["_id"].eqNullSafe(nodes["_id"])).select("node", "n", "words")
    return made.groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words"))


def _verified(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose word sequences are similar. Leaders' sequences join last, where AQE may split a hot leader."""
    with_b = pairs.join(sequences.select(F.col("node").alias("b"), F.col("words").alias("_b")), "b")
    with_both = with_b.join(sequences.select(F.col("node").alias("a"), F.col("words").alias("_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            good, last, words = [], None, None
            for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                x = x.as_py()
                if x != last:
                    last, words = x, np.frombuffer(unpack.decompress(x), "<u4")
                good.append(similar(words, np.frombuffer(unpack.decompress(y.as_py()), "<u4"), similarity))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return with_both.select("a", "b", "_a", "_b").mapInArrow(run, "a bigint, b bigint")


def _bags(sequences: DataFrame) -> DataFrame:
    """node, label, places, n and bag: how often words fall into each of BINS bins; null where a bin has more than a byte holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            bags = []
            for packed in batch.column("words").to_pylist():
                counts = np.bincount(np.frombuffer(unpack.decompress(packed), "<u4") % BINS, minlength=BINS)
                bags.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bags, pa.binary())], names=[*kept, "bag"])

    kept = ["node", "label", "places", "n"]
    return sequences.select(*kept, "words").mapInArrow(run, f"node bigint, label bigint, places {sequences.schema['places'].dataType.simpleString()}, n bigint, bag binary")


_BLOCK_KEY = ["of", "block", "i", "j"]
_BUCKET, _COMPONENT = 0, 1


def _blocks(members: DataFrame, labels: DataFrame, sequences: DataFrame, store: Scratch) -> DataFrame:
    """Rows of blocks (of, block, i, j) in which every pair of a bucket with ends in different components meets.

    The texts outside of a bucket's largest component meet each other in blocks of the bucket, and that component's texts in
    blocks of the component, where a text stands once for all the buckets that it shares. So pairs without a common bucket
    meet there too, and have to be left out before they are aligned. First are the texts outside, by i; they meet those by j,
    in blocks of a bucket, where both are the same texts, only from i on.
    """
    of_node = labels.select(F.col("id").alias("node"), "label")
    known = members.join(of_node, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    parts = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    parts = parts.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    rest = F.when(F.col("parts") > 2, F.ceil((F.col("all") - F.col("largest.n")) / BLOCK))
    counts = parts.select("bucket", F.col("largest.label").alias("largest"), rest.alias("rest"))
    outside = known.join(counts, "bucket").where("label <> largest")
    in_bucket = F.when(F.col("rest").isNotNull(), F.struct("bucket", "rest"))
    own = outside.groupBy("node", "label").agg(F.collect_list(in_bucket).alias("buckets"), F.collect_set("largest").alias("largest"))  # as many as a text has sketches
    own = store.table(own, "outside")
    near = own.select("node", "label", F.explode("largest").alias("block"))
    every = sequences.select("node").join(of_node, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    sizes = near.groupBy("block").agg(F.count("*").alias("outside")).join(every.groupBy(F.col("label").alias("block")).agg(F.count("*").alias("inside")), "block")
    sizes = store.table(sizes.select("block", F.ceil(F.col("outside") / BLOCK).alias("is"), F.ceil(F.col("inside") / BLOCK).alias("js")), "sizes")

    def place(of: int, block: str, i: str, j: str, first: bool, second: bool) -> Column:
        columns = {"of": F.lit(of).cast("bigint"), "block": F.col(block), "is": F.col(i), "js": F.col(j), "first": F.lit(first), "second": F.lit(second)}
        return F.struct(*(c.alias(name) for name, c in columns.items())).alias("place")

    places = own.select("node", "label", F.explode("buckets").alias("in")).select("node", "label", place(_BUCKET, "in.bucket", "in.rest", "in.rest", True, True))
    places = places.unionByName(near.join(sizes, "block").select("node", "label", place(_COMPONENT, "block", "is", "js", True, False)))
    places = places.unionByName(every.join(sizes, F.col("label") == F.col("block")).select("node", "label", place(_COMPONENT, "block", "is", "js", False, True)))
    places = places.groupBy("node", "label").agg(F.collect_list("place").alias("places"))
    bags = store.table(_bags(sequences.join(places, "node")), "bags")
    store.drop(own, sizes)
    salt = F.xxhash64("node")

    def cells(place: Column) -> Column:
        def cell(i: Column, j: Column, first: bool) -> Column:
            return F.struct(place["of"].alias("of"), place["block"].alias("block"), i.alias("i"), j.alias("j"), F.lit(first).alias("first"))

        own_i, own_j, zero, both = F.pmod(salt, place["is"]), F.pmod(salt, place["js"]), F.lit(0).cast("bigint"), place["first"] & place["second"]
        seconds = F.transform(F.sequence(zero, F.when(both, own_j).otherwise(place["is"] - 1)), lambda i: cell(i, own_j, False))
        firsts = F.transform(F.sequence(F.when(both, own_i).otherwise(zero), place["js"] - 1), lambda j: cell(own_i, j, True))
        return F.when(both, F.concat(seconds, firsts)).when(place["first"], firsts).otherwise(seconds)

    rows = bags.withColumn("cell", F.explode(F.flatten(F.transform("places", cells))))
    buckets = F.transform(F.filter("places", lambda p: p["of"] == _BUCKET), lambda p: p["block"])
    return rows.select("cell.*", "node", "label", "n", "bag", F.when(F.col("cell.of") == _BUCKET, buckets).alias("others"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by block to one batch for each block."""
    begun: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _BLOCK_KEY])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if begun and any(begun[0].column(c)[0] != part.column(c)[0] for c in _BLOCK_KEY):
                yield pa.concat_batches(begun)
                begun = []
            begun.append(part)
    if begun:
        yield pa.concat_batches(begun)


def _meet_earlier(block: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y also share a bucket with a lesser key, in a block of a bucket."""
    lists = block.column("others")
    row = np.repeat(np.arange(block.num_rows), np.diff(lists.offsets.to_numpy()))
    others = lists.flatten().to_numpy()
    earlier = others < block.column("block")[0].as_py()
    _, number, count = np.unique(others[earlier], return_inverse=True, return_counts=True)
    row, number = row[earlier][count[number] > 1], (np.cumsum(count > 1) - 1)[number[count[number] > 1]]
    met = np.zeros((len(x), len(y)), bool)
    for low in range(0, int((count > 1).sum()), 2048):
        here = (number >= low) & (number < low + 2048)
        has = np.zeros((block.num_rows, 2048), np.float32)
        has[row[here], number[here] - low] = 1
        met |= has[x] @ has[y].T > 0
    return met


def _possible(block: pa.RecordBatch, similarity: float) -> list[tuple[int, int]]:
    """Nodes of the pairs of a block that have ends in different components, and lengths and bags that allow a link.

    A pair that meets in the blocks of several buckets counts in the one with the least key.

    An edit changes one word, so a link needs all but (1 - similarity) of the longer text's words in common, and no more
    words are in common than the bins of both bags are.
    """
    first = block.column("first").to_numpy(zero_copy_only=False)
    nodes, labels, n = (block.column(c).to_numpy() for c in ("node", "label", "n"))
    x, y = np.flatnonzero(first), np.flatnonzero(~first)
    longer = np.maximum(n[x][:, None], n[y])
    limit = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    wanted = (labels[x][:, None] != labels[y]) & (np.abs(n[x][:, None] - n[y]) <= limit)
    if block.column("of")[0].as_py() == _BUCKET:
        if block.column("i")[0] == block.column("j")[0]:
            wanted &= nodes[x][:, None] < nodes[y]
        wanted &= ~_meet_earlier(block, x, y)
    if not wanted.any():
        return []
    bags = block.column("bag")
    unknown = bags.is_null().to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(bytes(BINS) if b is None else b for b in bags.to_pylist()), np.uint8).reshape(-1, BINS)
    for at in np.flatnonzero(wanted.any(axis=1)):
        others = np.flatnonzero(wanted[at])
        others = others[~unknown[y[others]]] if not unknown[x[at]] else others[:0]
        common = np.minimum(bins[x[at]], bins[y[others]]).sum(axis=1, dtype=np.uint32).astype(np.int64)
        wanted[at, others] = common >= longer[at, others] - limit[at, others]
    return [(int(nodes[x[i]]), int(nodes[y[j]])) for i, j in np.argwhere(wanted)]


def _links_across(members: DataFrame, labels: DataFrame, sequences: DataFrame, similarity: float, store: Scratch) -> DataFrame:
    """Links(a, b) of all pairs that share a bucket but not a component. Pairs are named only inside a block's task."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a block that have to be aligned, with those that they have to be aligned with."""
        for block in _by_block(batches):
            partners: dict[int, list[int]] = {}
            for a, b in _possible(block, similarity):
                partners.setdefault(a, []).append(b)
                partners.setdefault(b, [])
            if partners:
                key = [pa.array([block.column(c)[0].as_py()] * len(partners), pa.int64()) for c in _BLOCK_KEY]
                label = dict(zip(block.column("node").to_pylist(), block.column("label").to_pylist(), strict=True))
                own = [pa.array(list(partners), pa.int64()), pa.array([label[x] for x in partners], pa.int64()), pa.array(list(partners.values()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*key, *own], names=[*_BLOCK_KEY, "node", "label", "partners"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join components of the block; what earlier links of the block have joined isn't aligned again.

        In blocks of a component only texts that share a bucket are aligned."""
        unpack = zstandard.ZstdDecompressor()
        for block in _by_block(batches):
            nodes = block.column("node").to_pylist()
            packed = dict(zip(nodes, block.column("words").to_pylist(), strict=True))
            label = dict(zip(nodes, block.column("label").to_pylist(), strict=True))
            above = {x: x for x in label.values()}
            buckets = dict(zip(nodes, map(frozenset, block.column("buckets").to_pylist()), strict=True)) if block.column("of")[0].as_py() == _COMPONENT else None

            def top(x: int, above=above) -> int:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            good = []
            for a, partners in zip(nodes, block.column("partners").to_pylist(), strict=True):
                words = np.frombuffer(unpack.decompress(packed[a]), "<u4") if partners else None
                for b in partners or ():
                    if buckets is not None and buckets[a].isdisjoint(buckets[b]):
                        continue
                    one, other = top(label[a]), top(label[b])
                    if one != other and similar(words, np.frombuffer(unpack.decompress(packed[b]), "<u4"), similarity):
                        above[one] = other
                        good.append((a, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*good, strict=True)], names=["a", "b"])

    together = _blocks(members, labels, sequences, store).repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    work = store.table(together.mapInArrow(possible, "of bigint, block bigint, i bigint, j bigint, node bigint, label bigint, partners array<bigint>"), "work")
    apart = store.table(work.where(F.col("of") == _COMPONENT).select("node").distinct(), "apart")
    apart = F.broadcast(apart) if apart.count() <= BROADCAST_ROWS else apart
    buckets = members.join(apart, "node", "left_semi").groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    work = work.join(sequences.select("node", "words"), "node").join(buckets, "node", "left")
    work = work.withColumn("buckets", F.when(F.col("of") == _COMPONENT, F.col("buckets"))).repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    return work.mapInArrow(aligned, "a bigint, b bigint")


def _known(rows: DataFrame, similarity: float, sketches_: int, minima: int, k: int, more: int) -> DataFrame:
    """For every distinct text with words: digest, class_id, the digest of its class's text that stays, and n_copies.

    The table stays in the shared folder, as what is returned is read from it."""
    with Scratch(rows.sparkSession) as store:
        sketched = store.table(_sketched(rows, sketches_, minima, k, more, similarity).withColumn("node", F.monotonically_increasing_id()), "sketches")
        about = sketched.groupBy("_digest").agg(F.min("node").alias("node"), F.min("_id").alias("_id"), F.sum("_count").alias("n_copies"))
        about = store.table(about, "texts")
        copies = sketched.select("_digest", F.col("node").alias("_copy")).join(about.select("_digest", "node"), "_digest").where("_copy <> node").select("_copy")
        copies = store.table(copies, "copies")
        distinct = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
        buckets = sketched.join(distinct, sketched["node"] == distinct["_copy"], "left_anti").select("node", F.explode("_sketches").alias("bucket"))
        shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
        members = store.table(buckets.join(shared, "bucket", "left_semi"), "members")
        store.drop(sketched, copies)
        sequences = store.table(_sequences(rows, about.join(members.select("node").distinct(), "node", "left_semi").select("node", "_digest", "_id")), "sequences")
        leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"))
        led = members.join(leaders, "bucket")
        together = led.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
        best = together.groupBy("node").agg(F.max(F.struct(F.col("n"), (-F.col("leader")).alias("first"), F.col("leader"))).alias("best"))
        led = best.select(F.col("best.leader").alias("a"), F.col("node").alias("b"))
        links = store.table(_verified(led, sequences, similarity), "links")
        labels = linked_components(links, store)
        more = store.table(_links_across(members, labels, sequences, similarity, store), "links")
        store.drop(members, sequences)
        labels = joined_components(labels.select("id", "label"), more, store)
        linked = store.table(labels.select("id", "label").join(about.select(F.col("node").alias("id"), "_id", "_digest"), "id"), "linked")
        least = linked.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_digest")).alias("least"))
        of_node = linked.join(least, "label").select(F.col("id").alias("node"), F.col("least").alias("_class"))
        own = F.struct(F.col("_id").isNull().alias("none"), "_id", "_digest")
        known = about.join(of_node, "node", "left").select("_digest", "n_copies", F.coalesce("_class", own).alias("_class"))
        return store.table(known.select("_digest", F.col("_class._id").alias("class_id"), F.col("_class._digest").alias("_chosen"), "n_copies"), "near-duplicates", keep=True)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches_: int = SKETCHES, minima: int = MINIMA, k: int = K, more: int = MORE_SKETCHES) -> DataFrame:
    """For every row: key, class_id (the least id of its class), n_copies of its text."""
    rows = _rows(docs, key, text)
    known = _known(rows, similarity, sketches_, minima, k, more)
    found = rows.select("_id", "_digest").join(known, "_digest", "left")
    return found.select(
        F.col("_id").alias(key), F.when(F.col("n_copies").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sketches_: int = SKETCHES, minima: int = MINIMA, k: int = K, more: int = MORE_SKETCHES) -> DataFrame:
    """One row of each class, with the columns of docs. Only ids and digests are shuffled while few rows go."""
    rows = _rows(docs, key, text)
    known = _known(rows, similarity, sketches_, minima, k, more)
    with Scratch(docs.sparkSession) as store:
        placed = rows.select("_id", "_digest").join(known, "_digest")
        stays = (F.col("_digest") == F.col("_chosen")) & F.col("_id").eqNullSafe(F.col("class_id"))
        gone = store.table(placed.where(~stays).select(F.col("_id").alias("_gone"), F.col("_digest").alias("_gone_digest")).distinct(), "gone", keep=True)
        nameless = not known.where("class_id IS NULL AND _digest = _chosen AND n_copies > 1").isEmpty()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    marked = docs.toDF(*names).withColumns({"_id": F.col(names[docs.columns.index(key)]).cast("bigint"), "_digest": _digest(F.col(names[docs.columns.index(text)]))})
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = marked.join(gone, (marked["_digest"] == gone["_gone_digest"]) & marked["_id"].eqNullSafe(gone["_gone"]), "left_anti")
    if nameless:
        words = F.col(names[docs.columns.index(text)]).rlike(r"[^\x20\x09-\x0D]")
        many = F.col("_id").isNull() & F.coalesce(words, F.lit(False))
        kept = kept.where(~many).unionByName(kept.where(many).dropDuplicates(["_digest"]))
    return kept.select(names).toDF(*docs.columns)
