"""A table function over a table argument: rows packed in order, as no window can."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pyspark.sql.functions import lit, udtf


@udtf
class CappedBatches:
    """capped_batches(TABLE(t) PARTITION BY .. ORDER BY .., by, value, cap): successive rows packed while their values sum to at most cap.

    Called once for each row of a partition, in order, it holds the sum of the batch that is open and nothing else: a batch comes out
    when a row doesn't fit any more, and the last one at the end. Where a batch begins depends on where all before it
    ended, so sums over windows can't say it. by names the columns of PARTITION BY, comma-separated, which come out with each batch.

    A null value counts as 0; a value over cap is a batch of its own. Null keys are a partition. Rows that the order doesn't
    tell apart come in any order. A table without rows has no batches.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, value: AnalyzeArgument, cap: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f for f in rows.dataType.fields}
        missing = [c for c in [*by.value.split(","), value.value] if c not in kinds]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        own = [StructField("batch", LongType()), StructField("n_rows", LongType()), StructField("total", DoubleType())]
        return AnalyzeResult(StructType([kinds[c] for c in by.value.split(",")] + own))

    def __init__(self):
        self._key, self._batch, self._n, self._total = None, 0, 0, 0.0

    def eval(self, row: Row, by: str, value: str, cap: float) -> Iterator[tuple]:
        if self._key is None:
            self._key = tuple(row[c] for c in by.split(","))
        more = row[value] or 0.0
        if self._n and self._total + more > cap:
            yield (*self._key, self._batch, self._n, self._total)
            self._batch, self._n, self._total = self._batch + 1, 0, 0.0
        self._n, self._total = self._n + 1, self._total + more

    def terminate(self) -> Iterator[tuple]:
        if self._n:
            yield (*self._key, self._batch, self._n, self._total)


def capped_batches(df: DataFrame, by: list[str], order: list[str], value: str, cap: float) -> DataFrame:
    """by, batch (from 0), n_rows and total of each batch. One shuffle and sort by the keys; see CappedBatches."""
    table = df.select(*dict.fromkeys([*by, *order, value])).asTable().partitionBy(*by).orderBy(*order)
    return CappedBatches(table, lit(",".join(by)), lit(value), lit(float(cap)))


def register(spark: SparkSession) -> None:
    """Makes capped_batches a function of SQL in the session."""
    spark.udtf.register("capped_batches", CappedBatches)
