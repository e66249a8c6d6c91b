"""Running a stream over what is there, with its output as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sparkloom.streaming.stateful import STATE_STORE


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of queries that start inside; the session's setting comes back afterwards."""
    key, value = STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Takes all input that is there through the stream and returns every row that came out, from tables below path.

    Each batch is a table of its own that a second attempt at the batch replaces, so a run that stopped half-way gives each
    row once when it is run again with the same path: it goes on from the checkpoint there.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    with state_store(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/batch=*")
