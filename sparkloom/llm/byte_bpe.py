"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

encode() has two styles with the same results, and neither shuffles. With style="words" each worker process folds the
distinct words of its rows itself, those of a slice together as rows of an array, keeps what it has folded (a bounded number
of pieces, for the tasks of one stage) and puts the texts together.
With style="higher_order" the fold is one of Spark's higher-order functions:

1. Texts are taken in bounded batches. A batch becomes one row: its texts as numbers of its distinct words (the matches
   of the pattern), and an array of those words as arrays of byte ids.
2. ``transform`` goes over the words, and for each ``aggregate`` folds merges over the array of its bytes' ids: every
   step looks up the rank of each neighbouring pair in a literal rank map, takes the lowest rank with ``array_min`` and
   puts the merged id in the pair's place, until no pair has a rank.
3. The ids of the row's words are put in the places of its texts.

The rank map is a literal array: the pair (left id, right id) is at offset[left] + right, laid out so that no two pairs
meet (row displacement), and each entry keeps its left id. Its size is that of the rank file, whatever the corpus.

Defined cases: null counts as empty, and an empty text has no ids; repeated rows and ids are kept; an empty table gives
an empty result; further columns pass through, except those that clash with the result's.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.llm import _text as tx
from sparkloom.llm.quality import _schema, _with_columns

#: About so many bytes of text make a batch of the higher-order style.
BATCH_BYTES = 8 << 20
NONE = 1 << 17
#: Bits of a position in a word, beside the 17 of a rank.
_PLACE = 31

# Letters and numbers of the regex module's Unicode tables that are none in the library's (Unicode 16).
NEWER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    r"\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def finder(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern, with letters and numbers as the library knows them."""
    plain = regex.compile(pattern).findall
    newer = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]").search
    older = pattern.replace(r"\p{L}", f"[\\p{{L}}--[{NEWER_LETTERS}]]").replace(r"\p{N}", f"[\\p{{N}}--[{NEWER_NUMBERS}]]")
    careful = regex.compile(older, regex.V1).findall
    return lambda text: plain(text) if text.isascii() or not newer(text) else careful(text)


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def pair_arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """offsets by left id, and entries left << 17 | rank (or -1) at offsets[left] + right. One more id has no pair on either side."""
    ranks = load_ranks(path)
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    width = max(ranks.values()) + 1
    room = 3 * sum(map(len, rows.values())) + width
    used = np.zeros(room + width, bool)
    offsets = np.zeros(width + 1, np.int64)
    low, draw = 0, np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        right = np.fromiter(row, np.int64)
        while used[right + low].any():
            low = int(draw.integers(room))
        used[right + low] = True
        offsets[left] = low
    entries = np.full(int(np.flatnonzero(used).max(initial=0)) + width + 1, -1, np.int64)
    for left, row in rows.items():
        for right, rank in row.items():
            entries[offsets[left] + right] = left << 17 | rank
    return offsets, entries


def pair_table(path: str) -> tuple[list[int], list[int]]:
    offsets, entries = pair_arrays(path)
    return offsets[:-1].tolist(), entries.tolist()


def _literal(values: list[int], kind: T.DataType) -> Column:
    """A long array as one constant; the optimiser evaluates it once."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), T.ArrayType(kind))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_merges(byte_ids: Column, tables: Column) -> Column:
    """The ids of one word from the ids of its bytes. tables: struct of offsets and entries."""

    def rank(left: Column, right: Column) -> Column:
        entry = F.get(tables["entries"], F.get(tables["offsets"], left) + right)
        return F.when(F.shiftright(entry, 17) == left, entry.bitwiseAND(F.lit(NONE - 1).cast("bigint"))).otherwise(F.lit(NONE).cast("bigint"))

    def lowest(ids: Column) -> Column:
        pairs = F.transform(ids, lambda right, i: F.shiftleft(rank(F.get(ids, i - 1), right), _PLACE).bitwiseOR(i.cast("bigint")))
        return F.array_min(pairs)

    def merged(ids: Column, low: Column) -> Column:
        at = low.bitwiseAND(F.lit((1 << _PLACE) - 1).cast("bigint")).cast("int")
        return F.concat(F.slice(ids, F.lit(1), at - 1), F.array(F.shiftright(low, _PLACE).cast("int")), F.slice(ids, at + 2, F.size(ids)))

    def step(state: Column, _: Column) -> Column:
        ids = state["ids"]
        over = F.struct(ids.alias("ids"), F.lit(True).alias("over"))
        return F.when(state["over"], state).otherwise(
            _let(lowest(ids), lambda low: F.when(F.shiftright(low, _PLACE) >= NONE, over).otherwise(F.struct(merged(ids, low).alias("ids"), F.lit(False).alias("over"))))
        )

    start = F.struct(byte_ids.alias("ids"), (F.size(byte_ids) < 2).alias("over"))
    return F.aggregate(byte_ids, start, step)["ids"]


def _batches(rows: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Runs of whole rows with about limit bytes of text."""
    held, size = [], 0
    for batch in rows:
        for part in tx.slices(batch, text):
            held.append(part)
            size += len(tx.text_bytes(part.column(text))[0])
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _odd_space(text: str) -> bool:
    """Whether there is white space that isn't a single space or line feed between other characters, or nothing else."""
    parts = text.split()
    gaps = len(parts) - 1
    return text.count(" ") + text.count("\n") != gaps or len(text) - sum(map(len, parts)) != gaps


class _Splitter:
    """Numbers the distinct words of one batch.

    A single space or line feed between other characters always ends a match, so pieces between those are split once
    and looked up afterwards; a text with other white space is given to the pattern whole.
    """

    def __init__(self, pattern: str):
        self.find = finder(pattern)
        self.words: dict[str, int] = {}
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.plain: dict[str, tuple[int, ...]] = {}

    def numbers(self, piece: str) -> tuple[int, ...]:
        words = self.words
        return tuple([words.setdefault(w, len(words)) for w in self.find(piece)])

    def split(self, text: str) -> list[int]:
        if not text:
            return []
        if _odd_space(text):
            return list(self.numbers(text))
        out: list[int] = []
        spaced, plain = self.spaced, self.plain
        for n, line in enumerate(text.split("\n")):
            if n:
                out.extend(self.numbers("\n"))
            pieces = line.split(" ")
            first = pieces[0]
            if first not in plain:
                plain[first] = self.numbers(first)
            out.extend(plain[first])
            for piece in pieces[1:]:
                try:
                    out += spaced[piece]
                except KeyError:
                    spaced[piece] = known = self.numbers(" " + piece)
                    out += known
        return out


#: Pieces of up to 64 characters that a worker process keeps the ids of, at about 200 bytes each, for the tasks of one stage.
KEPT_PIECES = 200_000


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the neighbouring pieces whose union has the lowest rank are merged until none has one."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    pieces = [word[i : i + 1] for i in range(len(word))]
    if len(word) > 100:
        return _fold_long(pieces, ranks)
    get, none = ranks.get, NONE
    near = [get(a + b, none) for a, b in zip(pieces, pieces[1:], strict=False)]
    while near and (low := min(near)) < none:
        i = near.index(low)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del near[i]
        if i:
            near[i - 1] = get(pieces[i - 1] + pieces[i], none)
        if i < len(near):
            near[i] = get(pieces[i] + pieces[i + 1], none)
    return [ranks[p] for p in pieces]


def _fold_long(pieces: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """As fold_word with a heap of pairs, for words of any length."""
    after, before = list(range(1, len(pieces) + 1)), list(range(-1, len(pieces) - 1))
    pairs = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)) if a + b in ranks]
    heapq.heapify(pairs)
    gone: list[bytes | None] = list(pieces)

    def offer(i: int) -> None:
        j = after[i]
        if j < len(gone) and (rank := ranks.get(gone[i] + gone[j])) is not None:
            heapq.heappush(pairs, (rank, i, gone[i], gone[j]))

    while pairs:
        _, i, a, b = heapq.heappop(pairs)
        j = after[i]
        if gone[i] != a or j >= len(gone) or gone[j] != b:
            continue
        gone[i], gone[j] = a + b, None
        after[i] = after[j]
        if after[j] < len(gone):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in gone if p is not None]


#: Words of up to so many bytes are folded together, so many at once; each group is filled up to the least of these lengths that holds it.
_WIDTHS, _ROWS = (4, 6, 8, 10, 12, 16, 24, 32, 48), 1 << 14
#: Fewer words than this are folded one by one.
_FEW_WORDS = 64


def fold_rows(ids: np.ndarray, ranks_path: str) -> np.ndarray:
    """As fold_word for words of one row each: ids of their bytes, filled up at the end with the id that has no pair. In the result too."""
    offsets, entries = pair_arrays(ranks_path)
    fill = len(offsets) - 1

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        entry = entries[offsets[left] + right]
        return np.where(entry >> 17 == left, entry & (NONE - 1), NONE)

    made = np.full(ids.shape, fill, ids.dtype)
    rows, near = np.arange(len(ids)), rank(ids[:, :-1], ids[:, 1:])
    while len(rows):
        width = ids.shape[1]
        at = near.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
        low = near[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NONE)
        over = low >= NONE
        if over.any():
            made[rows[over], :width] = ids[over]
            rows, ids, near, at, low = (x[~over] for x in (rows, ids, near, at, low))
            if not len(rows):
                break
        here, place = np.arange(len(rows)), np.arange(width - 1)
        ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
        ids[here, at] = low
        near = np.take_along_axis(near, place[:-1] + (place[:-1] >= at[:, None]), axis=1)
        some = np.flatnonzero(at > 0)
        near[some, at[some] - 1] = rank(ids[some, at[some] - 1], low[some])
        some = np.flatnonzero(at < width - 2)
        near[some, at[some]] = rank(low[some], ids[some, at[some] + 1])
    return made


class _WordFolder:
    """Encodes texts piece by piece. A piece is what stands between spaces, with the line feed before it if there is one."""

    def __init__(self, ranks_path: str, pattern: str):
        self.path, self.ranks = ranks_path, load_ranks(ranks_path)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.find = finder(pattern)
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def fold(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words one after another, where each word's begin (and the last one's end), and each word's first byte."""
        raw = list(map(str.encode, words))
        whole = np.fromiter(map(self.ranks.get, raw, repeat(NONE)), np.int64, len(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        count, fill = np.ones(len(raw), np.int64), len(pair_arrays(self.path)[0]) - 1
        folded, least = [], 0
        for width in _WIDTHS:
            group = np.flatnonzero((whole == NONE) & (size > least) & (size <= width))
            least = width
            for at in (group[i : i + _ROWS] for i in range(0, len(group), _ROWS)):
                place = np.arange(width)
                there = place < size[at][:, None]
                ids = np.where(there, self.of_byte[data[np.minimum(start[at][:, None] + place, len(data) - 1)]], fill)
                made = fold_rows(ids, self.path)
                count[at] = (made != fill).sum(axis=1)
                folded.append((at, made))
        long = [(i, fold_word(raw[i], self.ranks)) for i in np.flatnonzero((whole == NONE) & (size > least)).tolist()]
        for i, ids in long:
            count[i] = len(ids)
        begin = np.append(0, np.cumsum(count))
        flat = np.empty(begin[-1], "<u4")
        alone = np.flatnonzero(whole < NONE)
        flat[begin[alone]] = whole[alone]
        for at, made in folded:
            real = made != fill
            flat[(begin[at][:, None] + np.arange(made.shape[1]))[real]] = made[real]
        for i, ids in long:
            flat[begin[i] : begin[i + 1]] = ids
        return flat, begin, data[start]

    def ids(self, piece: str) -> bytes:
        words = self.find(piece)
        if len(words) >= _FEW_WORDS:
            return self.fold(words)[0].tobytes()
        return array("I", [i for w in words for i in fold_word(w.encode(), self.ranks)]).tobytes()

    def learn(self, new: list[str]) -> None:
        """A single space or line feed before a piece always begins a match, so many pieces are given to the pattern as one text."""
        plain = [p for p in new if p.isascii()]  # so that few have to be searched for newer letters
        other = [p for p in new if not p.isascii()]
        for part in (x[i : i + _ROWS] for x in (plain, other) for i in range(0, len(x), _ROWS)):
            words = self.find("".join([p if p[0] == "\n" else " " + p for p in part]))
            flat, begin, byte = self.fold(words)
            first = np.flatnonzero((byte == 32) | (byte == 10))
            if len(first) != len(part):
                self.known.update((p, self.ids(p if p[0] == "\n" else " " + p)) for p in part)
                continue
            raw, cuts = flat.tobytes(), (np.append(begin[first], begin[-1]) * 4).tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) + len(self.first) > KEPT_PIECES:
            # Those that came first are the most frequent.
            self.known, self.first = (dict(islice(x.items(), KEPT_PIECES // 2)) for x in (self.known, self.first))
        known, first = self.known, self.first
        split = [None if _odd_space(t) else t.replace("\n", " \n").split(" ") for t in texts]
        begun = [p and p.pop(0) for p in split]
        new = set().union(*filter(None, split)).difference(known)
        self.learn(list(new))
        out = []
        for text, begin, pieces in zip(texts, begun, split, strict=True):
            if pieces is None:
                out.append(self.ids(text))
                continue
            if begin not in first:
                first[begin] = self.ids(begin)
            out.append(first[begin] + b"".join(map(known.__getitem__, pieces)))
            if len(begin) > 64:
                del first[begin]
        for long in (p for p in new if len(p) > 64):
            del known[long]
        return out

    def text(self, text: str) -> bytes:
        return self.texts([text])[0]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", style: str = "words", batch_bytes: int = BATCH_BYTES, decoded: bool = False) -> DataFrame:
    """For every row of docs its columns without text, and ids binary (little-endian unsigned 32-bit integers).

    With decoded, also what the ids decode to, as decode() gives it; one worker process then does both.
    """
    if style == "higher_order":
        encoded = _encode_higher_order(docs, ranks_path, pattern, text, batch_bytes)
        return decode(encoded, ranks_path) if decoded else encoded
    new = {"ids": "binary"} | ({"decoded": "binary"} if decoded else {})
    carried = docs.drop(text, *new)
    names = carried.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tx.held(f"pieces {ranks_path} {pattern}", lambda: _WordFolder(ranks_path, pattern))
        for batch in batches:
            for rows in tx.slices(batch, text):
                ids = folder.texts([t or "" for t in rows.column(text).to_pylist()])
                made = {"ids": pa.array(ids, pa.binary())}
                if decoded:
                    made["decoded"] = pa.array(concatenated(ids, ranks_path), pa.binary())
                yield _with_columns(rows.select(names), made)

    return docs.mapInArrow(run, _schema(carried, new))


def _encode_higher_order(docs: DataFrame, ranks_path: str, pattern: str, text: str, batch_bytes: int) -> DataFrame:
    carried = docs.drop(text, "ids")
    names = carried.columns

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch of texts as one row. A word that is a whole piece of the vocabulary has its rank as its only id."""
        ranks, pack = load_ranks(ranks_path), zstandard.ZstdCompressor(level=1)
        for table in _batches(rows, text, batch_bytes):
            splitter = _Splitter(pattern)
            numbers = [np.array(splitter.split(t or ""), np.uint32) for t in table.column(text).to_pylist()]
            words = [[whole] if (whole := ranks.get(w)) is not None else [ranks[w[i : i + 1]] for i in range(len(w))] for w in map(str.encode, splitter.words)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (kept := table.select(names)).schema) as out:
                out.write_table(kept)
            columns = (np.concatenate(numbers).tobytes(), np.array([len(x) for x in numbers], np.uint32).tobytes(), sink.getvalue().to_pybytes())
            packed = [pa.array([pack.compress(c)], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([*packed, pa.array([words], pa.list_(pa.list_(pa.int32())))], names=["numbers", "sizes", "rows", "words"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                numbers, sizes, rows = (unpack.decompress(batch.column(c)[row].as_py()) for c in ("numbers", "sizes", "rows"))
                ids = [array("I", w).tobytes() for w in batch.column("words")[row].as_py()]
                numbers, ends = np.frombuffer(numbers, np.uint32).tolist(), np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
                table = pa.ipc.open_stream(rows).read_all().combine_chunks()
                made = pa.array([b"".join(map(ids.__getitem__, numbers[a:b])) for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in table.columns), made], names=[*names, "ids"])

    offsets, entries = pair_table(ranks_path)
    tables = F.struct(_literal(offsets, T.IntegerType()).alias("offsets"), _literal(entries, T.LongType()).alias("entries"))
    folded = _let(tables, lambda t: F.transform("words", lambda word: fold_merges(word, t)))
    made = docs.mapInArrow(split, "numbers binary, sizes binary, rows binary, words array<array<int>>")
    return made.select("numbers", "sizes", "rows", folded.alias("words")).mapInArrow(put_together, _schema(carried, {"ids": "binary"}))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded binary: the pieces of the ids, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                texts = concatenated(rows.column(ids).to_pylist(), ranks_path)
                yield _with_columns(rows, {"decoded": pa.array(texts, pa.binary())})

    return encoded.mapInArrow(run, _schema(encoded, {"decoded": "binary"}))


def concatenated(ids: list[bytes | None], ranks_path: str) -> list[bytes]:
    get = _pieces(ranks_path).__getitem__
    return [b"".join(map(get, array("I", x or b""))) for x in ids]


@functools.cache
def _pieces(path: str) -> dict[int, bytes]:
    return {rank: piece for piece, rank in load_ranks(path).items()}
