"""Tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_any(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None) -> DataFrame:
    """Reads any of FORMATS. A schema spares csv and json the pass that infers one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write_any(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
