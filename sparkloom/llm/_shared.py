"""The folder that driver and executors share, for checkpoints, caches and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset and the master is local, as in tests, a folder of this
    machine is taken; on a cluster that would lose what executors write, so it is an error there."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="spark-shared-")
        place = _local["dir"]
    return (place if ":" in place else f"file://{place}").rstrip("/")


#: Rows and bytes of an Arrow batch. Spark's default of 10,000 rows is much memory where rows are whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of its rows at once, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, written once and read back. It stays there."""
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder, which go again when they have served.

    table() cuts the lineage as stored() does. drop() removes tables at once, leaving the context all that are left but
    those that were kept: what the operator returns may read only kept tables.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._tables: dict[int, tuple[DataFrame, str]] = {}
        self._paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in list(self._tables.values())))
        for path in self._paths:
            self._delete(path)

    def path(self, name: str, keep: bool = False) -> str:
        """A folder of its own in the shared one."""
        made = fresh_path(self._spark, name)
        if not keep:
            self._paths.append(made)
        return made

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = fresh_path(self._spark, name)
        made = _written(df, path)
        if not keep:
            self._tables[id(made)] = (made, path)
        return made

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self._tables:
                self._delete(self._tables.pop(id(df))[1])

    def _delete(self, path: str) -> None:
        there = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
