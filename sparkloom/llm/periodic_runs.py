"""Periodic run detection: aligned blocks of words, found again a scale-compatible distance further on, seed exact runs.

A run is a maximal stretch of words with smallest period q and at least max(6, 4 * q) words. It is looked for at the scale
L = 2**k with L <= q < 2L: blocks of L words that start at multiples of L are the keys of an automaton of integer sequences
(word numbers), which is taken across the words where they can occur again. An occurrence at a distance d with
L <= d < 2L is a seed; it is extended both ways, word by word, as long as words d apart are identical.

Why no run is missed: of a run's first ``length - q`` words, at least 3 * L, two neighbouring aligned blocks lie inside;
both occur again q words further on, and each of their words occurs again in less than 2L words. So only blocks that
pass this test, with the next block, become keys, and an occurrence belongs to one aligned block only. Blocks
and seeds inside a run of a shorter period are left out: two runs share fewer words than the sum of their periods.
Seeds and extensions are so proportional to the words of a scale, n * log(n) for a text.

A text is worked on alone, by word numbers of 4 bytes; the automaton holds KEYS_WORDS words of blocks at a time, or one block.

Defined cases: null and empty texts have no words, no runs, and collapse to the empty string; each row is judged on its
own, so repeated rows and ids (also null ids) get their own result; an empty table gives an empty result; further
columns pass through, except that the result's own columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm.quality import _schema, _with_columns

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words of blocks in one automaton, integers of a key, and bytes of text that are split into words at once.
KEYS_WORDS, KEY_CELLS, PIECE_BYTES = 1 << 16, 16, 1 << 20

RESULT = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at spaces or line ends into pieces of about PIECE_BYTES; a longer word is one piece."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        cut = max(text.rfind(b" ", start, start + PIECE_BYTES), text.rfind(b"\n", start, start + PIECE_BYTES))
        if cut <= start:
            cut = min((x for x in (text.find(b" ", start + PIECE_BYTES), text.find(b"\n", start + PIECE_BYTES)) if x >= 0), default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as numbers, and the distinct words by number."""
    numbers: dict[bytes, int] = {}
    parts = []
    for piece in _pieces(text):
        words = piece.split()  # of bytes: splits at exactly these six characters
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
    return np.concatenate(parts), list(numbers)


def _next_distance(words: np.ndarray, distinct: int) -> np.ndarray:
    """For each word, how many words further on it occurs again (a large number if it doesn't)."""
    order = np.argsort(words.astype(np.uint16) if distinct <= 1 << 16 else words, kind="stable")
    far = np.full(len(words), np.iinfo(np.int64).max)
    same = words[order[1:]] == words[order[:-1]]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def _same_ahead(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j > i on."""
    n, step, total = len(words), 64, 0
    while j + total < n:
        width = min(step, n - j - total)
        unlike = words[i + total : i + total + width] != words[j + total : j + total + width]
        if unlike.any():
            return total + int(unlike.argmax())
        total, step = total + width, step * 4
    return total


def _same_behind(words: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j > i."""
    step, total = 64, 0
    while total < i:
        width = min(step, i - total)
        unlike = (words[i - total - width : i - total] != words[j - total - width : j - total])[::-1]
        if unlike.any():
            return total + int(unlike.argmax())
        total, step = total + width, step * 4
    return total


def _cells(words: np.ndarray, width: int) -> np.ndarray:
    """A number for each position: equal where the width words from there on are. Unlike words may share one, by a hash."""
    if width == 1:
        return words
    up, down = tx.powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(tx.mix(words.astype(np.uint64) + np.uint64(1)) * up[: len(words)], out=total[1:])
    hashes = (total[width:] - total[:-width]) * down[: len(words) - width + 1]
    return np.unique(hashes, return_inverse=True)[1]


def _seeds(words: np.ndarray, blocks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start of a block, start of an occurrence of it) with a distance from size to 2 * size - 1, of blocks by number.

    Keys are KEY_CELLS integers at most: a longer block is the sequence of the numbers of its cells, and is searched for at each
    offset of cells in turn. So the automaton stays shallow, also where a text repeats one word.
    """
    at_once, width = max(1, KEYS_WORDS // size), max(1, size // KEY_CELLS)
    for k in range(0, len(blocks), at_once):
        for part in _neighbours(blocks[k : k + at_once]):
            start, stop = int(part[0]) * size, min(len(words), int(part[-1] + 3) * size)
            cells = _cells(words[start:stop], width)
            found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            key_of: dict[int, int] = {}
            keys: dict[tuple, int] = {}
            for b in part.tolist():
                key = tuple(cells[b * size - start : (b + 1) * size - start : width].tolist())
                key_of[b] = keys.setdefault(key, len(keys))
                found.add_word(key, key_of[b])
            found.make_automaton()
            for offset in range(width):
                for end, key in found.iter(tuple(cells[size + offset :: width].tolist())):
                    j = start + size + offset + (end + 1) * width - size
                    block = (j - size) // size  # the one aligned block at a distance from size to 2 * size - 1
                    if key_of.get(block) == key:
                        yield block * size, j


def _neighbours(blocks: np.ndarray) -> list[np.ndarray]:
    """The blocks (ascending numbers) in parts whose reaches don't overlap."""
    return np.split(blocks, np.flatnonzero(np.diff(blocks) > 2) + 1)


def _covered(runs: dict[tuple[int, int], int], at: np.ndarray) -> np.ndarray:
    """For each position the furthest end of the runs that start there or before."""
    spans = np.array(sorted(runs), np.int64).reshape(-1, 2)
    ends = np.concatenate([[0], np.maximum.accumulate(spans[:, 1])])
    return ends[np.searchsorted(spans[:, 0], at, side="right")]


def runs_of(words: np.ndarray, distinct: int) -> list[tuple[int, int, int]]:
    """All runs of a text as (start, length, period), by start, then period."""
    n = len(words)
    if n < MIN_WORDS or distinct == n:
        return []
    found: dict[tuple[int, int], int] = {}
    far, size = _next_distance(words, distinct), 1
    while size * MIN_EXPONENT <= n:
        likely = far < 2 * size  # per block: the greatest distance of its words
        first = np.flatnonzero(likely[:-1] & likely[1:])
        covered = _covered(found, first * size)
        first, covered = (x[covered < np.minimum((first + 3) * size, n)] for x in (first, covered))
        known = dict(zip((first * size).tolist(), covered.tolist(), strict=True))
        seen: dict[int, int] = {}
        fresh = {}
        for i, j in _seeds(words, first, size) if len(first) else ():
            period = j - i
            if i < seen.get(period, 0) or j + size <= known[i]:
                continue
            ahead, behind = _same_ahead(words, i, j), _same_behind(words, i, j)
            start, end = i - behind, j + ahead
            seen[period] = i + ahead
            if end - start >= max(MIN_WORDS, MIN_EXPONENT * period) and (start, end) not in found:
                fresh[start, end] = period
        found |= fresh
        far = np.maximum(far[0 : len(far) // 2 * 2 : 2], far[1 : len(far) // 2 * 2 : 2])
        size *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def _joined(words: np.ndarray, vocabulary: list[bytes]) -> bytes:
    return b" ".join([vocabulary[w] for w in words.tolist()])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (by start, then period) and collapsed: the words that stay, joined by one space. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tx.slices(batch, text):
                counts, lists, collapsed = [], [], []
                for value in rows.column(text).cast(pa.large_binary()):
                    words, vocabulary = word_numbers(value.as_py() or b"")
                    runs = runs_of(words, len(vocabulary))
                    counts.append(len(words))
                    lists.append(runs)
                    collapsed.append(_joined(words[kept_words(len(words), runs)] if runs else words, vocabulary))
                flat = np.array([r for runs in lists for r in runs], np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
                yield _with_columns(rows, {"n_words": pa.array(counts, pa.int64()), "runs": pa.ListArray.from_arrays(offsets, fields), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})

    return docs.mapInArrow(run, _schema(docs, RESULT))


def longest(runs: Column) -> Column:
    """The run with the greatest length; of equal ones that with the smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """Every run as `start,length,period` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def with_echoes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which about a tenth of the texts end in a repetition: test cases that are made from the table itself.

    With h = crc32(decimal key) and g = floor(h / 10), a text of n > 0 words with h % 10 = 0 has, from word a = g % n on, its words
    a to a + p - 1 again and again, p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and rows without a key, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_words", F.when(F.col("_g").isNotNull(), words))
    n, g = F.size("_words").cast("bigint"), F.col("_g")
    placed = chosen.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.floor((n - F.col("_a")) / (3 + g % 8)) + 1)
    echo = F.transform(F.sequence(F.lit(0).cast("bigint"), n - F.col("_a") - 1), lambda i: F.get(F.col("_words"), (F.col("_a") + i % F.col("_p")).cast("int")))
    changed = F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("_a").cast("int")), echo)
    return placed.withColumn(text, F.when(F.col("_a").isNotNull(), changed).otherwise(F.col(text))).drop("_g", "_words", "_a", "_p")
