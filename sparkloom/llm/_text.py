"""Shared task-side helpers: Arrow batches in bounded slices, and word scans of UTF-8 bytes with numpy.

Everything here runs inside a Spark task on one bounded slice of rows. A slice holds whole texts and about
``SLICE_BYTES`` of them (one text alone may be longer), so memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 512 << 10

# Separators of the word classes used by the operators, as bytes.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_powers: dict[str, np.ndarray] = {}


def separator_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64."""
    if n > len(_powers.get("up", ())):
        size = max(n, SLICE_BYTES + (1 << 18))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


class Words:
    """The words of a slice: byte spans, and the first word of each text (one entry more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        inside = ~separators[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.per_text = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_text)), self.per_text)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words inside one text: (index of the first word, hash)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += hashes[j : j + n] * _GRAM[j]
    inside = np.zeros(len(hashes) + 1, np.int32)
    last = np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(inside, first[:-1], 1)
    np.add.at(inside, last, -1)
    at = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    return at, mix(h[at])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: What the tasks of one stage share in a worker process: the stage, and values by name.
_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """The value of that name, made once in a worker process and stage. It goes when the process sees a slice of another stage."""
    _let_go()
    if name not in _held:
        _held[name] = make()
    return _held[name]


def _let_go() -> None:
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if _held.get("stage") != stage:
        _held.clear()
        _held["stage"] = stage


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows, about limit bytes of text each."""
    _let_go()
    _, offsets = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), batch.num_rows)
        yield batch.slice(row, stop - row)
        row = stop


def per_text_sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
