"""Ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1. Spark keeps only k rows of a group in each task before the shuffle.

    Rows that the order doesn't tell apart are ranked in any order; an order by a key makes the result one. Null keys are a
    group. A column of df named rank gives way to the rank.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("rank").withColumnRenamed("_rank", "rank")
