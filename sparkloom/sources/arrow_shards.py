"""A data source of Arrow files with a manifest: a partition for each shard, and shards that a filter rules out aren't opened.

A dataset is a folder of Arrow IPC files (zstd-compressed record batches) and a manifest that lists them with their rows and the
least and greatest value of one column, the key. Spark has no reader for such files of its own. Rows pass as Arrow batches both ways.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "arrow_shards"
MANIFEST = "_manifest.json"


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


def _plain(value: Any) -> Any:
    """A bound as JSON can hold it, in the order of the values; None for kinds without such a form."""
    if isinstance(value, dt.datetime):
        return (value.astimezone(dt.timezone.utc) if value.tzinfo else value).replace(tzinfo=None).isoformat(timespec="microseconds")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value if isinstance(value, (int, float, str)) else None


@dataclass
class Shard(InputPartition):
    """One file. low and high are None where the key's values have no bounds that could rule the file out."""

    file: str
    rows: int
    low: Any
    high: Any
    nulls: int

    def may_hold(self, test: Filter) -> bool:
        """Whether a row of the shard may pass a filter of the key."""
        if isinstance(test, IsNull):
            return self.nulls > 0
        if isinstance(test, EqualNullSafe) and test.value is None:
            return self.nulls > 0
        if self.nulls == self.rows:
            return False
        if isinstance(test, IsNotNull) or self.low is None:
            return True
        if isinstance(test, In):
            return any(self.low <= _plain(v) <= self.high for v in test.value if _plain(v) is not None) or any(_plain(v) is None and v is not None for v in test.value)
        value = _plain(test.value)
        if value is None or value != value or isinstance(value, str) != isinstance(self.low, str):
            return True
        if isinstance(test, (EqualTo, EqualNullSafe)):
            return self.low <= value <= self.high
        if isinstance(test, GreaterThan):
            return self.high > value
        if isinstance(test, GreaterThanOrEqual):
            return self.high >= value
        if isinstance(test, LessThan):
            return self.low < value
        return self.low <= value if isinstance(test, LessThanOrEqual) else True


@dataclass
class _Written(WriterCommitMessage):
    shards: list[Shard]


class ArrowShards(DataSource):
    """spark.read.format("arrow_shards").load(path), after register(spark).

    Null keys, shards without rows, and keys with NaN or of a kind that has no order here (decimals, binary) are read like any others;
    they only aren't ruled out by their bounds. Every filter is evaluated by Spark again, so a shard that is opened needlessly costs
    time and never rows.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(read_manifest(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("key", ""), schema, overwrite)


def read_manifest(path: str) -> dict:
    fs, folder = _place(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path
        self._tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        key = read_manifest(self._path)["key"]
        self._tests = [f for f in filters if getattr(f, "attribute", None) == (key,)]
        return filters  # bounds rule out files, not rows

    def partitions(self) -> Sequence[InputPartition]:
        shards = [Shard(**s) for s in read_manifest(self._path)["shards"]]
        chosen = [s for s in shards if s.rows and all(s.may_hold(t) for t in self._tests)]
        return chosen or [Shard("", 0, None, None, 0)]  # a plan needs one partition

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition.file:
            fs, folder = _place(self._path)
            with fs.open_input_file(f"{folder}/{partition.file}") as file, pa.ipc.open_file(file) as batches:
                for i in range(batches.num_record_batches):
                    yield batches.get_batch(i)


class _Writer(DataSourceArrowWriter):
    """A task writes one file under a name of its own; the manifest, written when all tasks have ended, makes files part of the dataset."""

    def __init__(self, path: str, key: str, schema: StructType, overwrite: bool):
        if key and key not in schema.names:
            raise ValueError(f"no column {key}")
        self._path, self._key, self._schema, self._overwrite = path, key, schema.jsonValue(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = _place(self._path)
        shard, out = Shard(f"{uuid.uuid4().hex}.arrow", 0, None, None, 0), None
        bounded = bool(self._key)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{shard.file}") as file:
            for batch in iterator:
                if out is None:
                    out = pa.ipc.new_file(file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(batch)
                shard.rows += batch.num_rows
                if self._key:
                    bounded = self._widen(shard, batch.column(self._key)) and bounded
            if out is not None:
                out.close()
        if not bounded:
            shard.low = shard.high = None
        if not shard.rows:
            fs.delete_file(f"{folder}/{shard.file}")
        return _Written([shard] if shard.rows else [])

    @staticmethod
    def _widen(shard: Shard, values: pa.Array) -> bool:
        """Takes the values into the bounds; false if they have none."""
        shard.nulls += values.null_count
        if pa.types.is_floating(values.type) and pc.any(pc.is_nan(values)).as_py():
            return False
        if values.null_count == len(values):
            return True
        try:
            found = pc.min_max(values).as_py()
        except pa.ArrowNotImplementedError:
            return False
        low, high = _plain(found["min"]), _plain(found["max"])
        if low is None or isinstance(low, float) and not math.isfinite(low + high):
            return False
        shard.low = low if shard.low is None else min(shard.low, low)
        shard.high = high if shard.high is None else max(shard.high, high)
        return True

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = _place(self._path)
        fs.create_dir(folder, recursive=True)
        before = []
        if fs.get_file_info(f"{folder}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            before = read_manifest(self._path)["shards"]
        made = [vars(s) for m in messages if m is not None for s in m.shards]
        listed = {"key": self._key, "schema": self._schema, "shards": made if self._overwrite else before + made}
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as file:
            file.write(json.dumps(listed).encode())
        for shard in before if self._overwrite else ():
            fs.delete_file(f"{folder}/{shard['file']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of tasks that had ended; without a manifest entry they were no part of the dataset."""
        fs, folder = _place(self._path)
        for shard in (s for m in messages if m is not None for s in m.shards):
            fs.delete_file(f"{folder}/{shard.file}")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to data sources in Python."""
    spark.dataSource.register(ArrowShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_shards(df: DataFrame, path: str, key: str, shards: int | None = None, mode: str = "overwrite") -> None:
    """df range-partitioned by key, so that the shards' bounds are apart and a filter of the key opens few of them."""
    register(df.sparkSession)
    dealt = df.repartitionByRange(shards, key) if shards else df.repartitionByRange(key)
    dealt.write.format(FORMAT).option("key", key).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(path)
