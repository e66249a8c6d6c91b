"""Token-id files: one zstandard frame per document, compressed with a shared dictionary.

A data set is a folder in a store that all machines share:

* ``dictionary``: the zstandard dictionary, trained on the serialised id arrays of a bounded sample of documents;
* ``shards/*.ids``: a header (magic, SHA-256 of the dictionary, bytes per id), then the frames in ascending key order;
* ``index``: a Parquet table with, for each document, its shard, file, frame offset and length, ids, and the number of
  ids before it in its shard.

Every frame can be read alone from its offset and length, so a short document costs one small read. A task writes its
file under a name of its own and the index names the files of the tasks that succeeded; a repeated task can't harm.

Documents meet in shards by ranges of their keys, and of a hash of their frames where one key fills several shards. A
shard has about SHARD_BYTES of frames, less where that leaves tasks idle, and a task begins another file after FILE_BYTES.
Only compressed frames are shuffled, once.

The dictionary is trained on SAMPLE_ROWS documents at most, those with the least hashes of their keys, and of a long one
on SAMPLE_PIECES pieces spread over it. Where they are too few to train on, their ids themselves are the dictionary.

Defined cases: null and empty texts have only the end id; repeated keys keep all their rows, in the order of a hash of
their content; an empty table gives an empty index; further columns are ignored; null keys come first.
"""

from __future__ import annotations

import hashlib
import uuid

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkloom.llm import _text as tx
from sparkloom.llm.tokenizing import tokenizer

MAGIC = b"IDSZ0001"
SAMPLE_ROWS = 1000
SAMPLE_PIECES, PIECE_CHARS = 4, 4096
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 256 << 20
FILE_BYTES = 8 << 20
#: Keys sampled for each shard, by which ranges are cut.
KEYS_PER_SHARD = 40
LEVEL = 3
END_ID = 1

INDEX_SCHEMA = "doc_id bigint, shard int, file string, offset bigint, length bigint, n_tokens bigint, before bigint"
_FRAMES = "doc_id bigint, shard int, place bigint, n_tokens bigint, frame binary"


@dataclass(frozen=True)
class Dataset:
    path: str
    dictionary_sha256: str


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def _width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where the samples are too few or too small to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def _sample(rows: DataFrame, n: int) -> tuple[list[str], list[int]]:
    """Up to n texts of the least key hashes over the whole table, of a long one SAMPLE_PIECES pieces; whole lengths."""
    length, room = F.length("text"), SAMPLE_PIECES * PIECE_CHARS
    pieces = [F.substring("text", (((length - PIECE_CHARS) * i / (SAMPLE_PIECES - 1)) + 1).cast("int"), F.lit(PIECE_CHARS)) for i in range(SAMPLE_PIECES)]
    short = F.when(length <= room, F.col("text")).otherwise(F.concat(*pieces))
    made = rows.select(F.xxhash64("doc_id").alias("h"), short.alias("text"), length.alias("n")).orderBy("h", "text").limit(n).toArrow()
    return made.column("text").to_pylist(), made.column("n").to_pylist()


def _shards(rows: DataFrame, n_shards: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cut keys, the shard of keys from each on, and over how many shards a key equal to one is spread."""
    share = min(1.0, KEYS_PER_SHARD * n_shards / n_rows)
    keys = rows.where("doc_id IS NOT NULL").select("doc_id").sample(share, 1).toArrow().column(0).to_numpy()
    keys = np.sort(keys)
    cuts = keys[(np.arange(1, n_shards) * len(keys)) // n_shards] if len(keys) else keys
    values, count = np.unique(cuts, return_counts=True)
    return values, np.cumsum(count) - count, count


def _place(keys: np.ndarray, hashes: np.ndarray, shards: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The shard of each row, ascending by key and, among rows of one key, by hash (unsigned)."""
    values, before, count = shards
    if not len(values):
        return np.zeros(len(keys), np.int32)
    at = np.searchsorted(values, keys)
    total = int(count.sum())
    shard = np.append(before, total)[at]
    same = np.flatnonzero((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == keys))
    spread = count[at[same]] + 1
    shard[same] += ((hashes[same] >> np.uint64(32)) * spread.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    return shard.astype(np.int32)


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, sample_rows: int = SAMPLE_ROWS) -> Dataset:
    """Encodes every text, appends end_id and writes the data set to path, a folder URI."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = tokenizer(tokenizer_path)
    width = _width(max(own.vocabulary, end_id + 1))
    end = array("I", [end_id]).tobytes()
    texts, lengths = _sample(rows, sample_rows)
    sample = [_narrow(x + end, width) for x in own.encode([t.encode() for t in texts])]
    dictionary = train_dictionary(sample)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, root = _fs(path)
    fs.create_dir(f"{root}/shards", recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)

    n_rows = rows.count()
    pack = _compressor(b"")  # those of the sample would be too small with the dictionary that was trained on them
    per_row = sum(len(pack.compress(x)) * n / max(1, len(t)) for x, t, n in zip(sample, texts, lengths, strict=True)) / max(1, len(sample))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(1, int(per_row * n_rows / shard_bytes), min(tasks, int(per_row * n_rows / file_bytes)))
    shards = _shards(rows, n_shards, n_rows) if n_shards > 1 else _shards(rows.limit(0), 1, 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = tokenizer(tokenizer_path), _compressor(dictionary)
        for batch in batches:
            for part in tx.slices(batch, "text"):
                ids = [x + end for x in known.encode(part.column("text").cast(pa.binary()).to_pylist())]
                keys = part.column("doc_id")
                frames = [pack.compress(_narrow(x, width)) for x in ids]
                hashes = np.array([int.from_bytes(hashlib.blake2b(f, digest_size=8).digest(), "little") for f in frames], np.uint64)
                shard = _place(keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), hashes, shards)
                place = pa.array((hashes >> np.uint64(1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([keys, pa.array(shard), place, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "shard", "place", "n_tokens", "frame"])

    header = MAGIC + bytes.fromhex(digest) + bytes([width])

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        shard, out, name, at, before = None, None, "", 0, 0
        for batch in batches:
            rows = {k: [] for k in ("file", "offset", "length", "before")}
            for number, n, frame in zip(batch.column("shard").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if number != shard or at >= file_bytes:
                    if out:
                        out.close()
                    before = before if number == shard else 0
                    shard, name, at = number, f"shards/{number:08d}-{uuid.uuid4().hex}.ids", len(header)
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(header)
                out.write(frame)
                for k, v in (("file", name), ("offset", at), ("length", len(frame)), ("before", before)):
                    rows[k].append(v)
                at += len(frame)
                before += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), pa.array(rows["file"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64()), batch.column("n_tokens"), pa.array(rows["before"], pa.int64())],
                names=["doc_id", "shard", "file", "offset", "length", "n_tokens", "before"],
            )
        if out:
            out.close()

    frames = rows.mapInArrow(encode, _FRAMES)
    ordered = frames.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "place", "frame")
    ordered.mapInArrow(write_shards, INDEX_SCHEMA).write.parquet(f"{path}/index")
    return Dataset(path, digest)


def read_index(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """The index, with start: the ids of all documents before this one. There is one row a shard to sum up."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{dataset.path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    ahead = totals.select("shard", (F.sum("_total").over(Window.orderBy("shard")) - F.col("_total")).alias("_ahead"))
    return index.join(ahead, "shard").withColumn("start", F.col("_ahead") + F.col("before")).drop("_ahead")


def read_documents(index: DataFrame, dataset: Dataset) -> DataFrame:
    """Reads the frame of each index row back from the files: doc_id, start and ids (little-endian unsigned 32-bit)."""
    path, digest = dataset.path, dataset.dictionary_sha256

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        with fs.open_input_stream(f"{root}/dictionary") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError(f"{path}: the dictionary is not the one that the frames were compressed with")
        unpack = _decompressor(dictionary)
        name, file, width = None, None, 4
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                ids = []
                for own, offset, length in zip(part.column("file").to_pylist(), part.column("offset").to_pylist(), part.column("length").to_pylist(), strict=True):
                    if own != name:
                        if file:
                            file.close()
                        name, file = own, fs.open_input_file(f"{root}/{own}")
                        head = file.read_at(len(MAGIC) + 33, 0)
                        if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) : -1].hex() != digest:
                            raise ValueError(f"{own}: not a shard of this data set")
                        width = head[-1]
                    raw = unpack.decompress(file.read_at(length, offset))
                    ids.append(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
        if file:
            file.close()

    return index.select("doc_id", "start", "file", "offset", "length").mapInArrow(load, "doc_id bigint, start bigint, ids binary")


