"""Quantiles and distinct counts from sketches that are stored per slice of a table and merged later, without its rows.

A slice is any group of rows that is written once, such as a day. Its row holds a KLL sketch of the values, a HyperLogLog sketch
of the keys and exact counts, some kilobytes whatever the number of rows; new slices are appended. Merged sketches have the error bounds of
one made from all rows: a quantile is that of a rank within RANK_ERROR of the one asked for, a distinct count within a few
per cent (its standard error is 1.04 / sqrt(2 ** lg_k)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: KLL's parameter and, for it, the rank error at 99 per cent confidence; HyperLogLog's parameter.
KLL_K, RANK_ERROR, HLL_LG_K = 200, 0.0165, 12


def slice_sketches(df: DataFrame, by: list[str], value: str, key: str, k: int = KLL_K, lg_k: int = HLL_LG_K) -> DataFrame:
    """One row per group of by: n_rows, n_values, least, greatest, values_sketch and keys_sketch. Sketches are partial
    aggregates, so no group's rows meet in one task. Nulls count as rows only; a group without values or keys has an empty sketch.
    """
    number = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count(value).alias("n_values"),
        F.min(number).alias("least"),
        F.max(number).alias("greatest"),
        F.kll_sketch_agg_double(number, k).alias("values_sketch"),
        F.hll_sketch_agg(key, lg_k).alias("keys_sketch"),
    )


def merge_sketches(slices: DataFrame, by: list[str]) -> DataFrame:
    """Slices made one row per group of by, which may be fewer columns than the slices were made by, or none."""
    return slices.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_values").alias("n_values"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("values_sketch").alias("values_sketch"),
        F.hll_union_agg("keys_sketch").alias("keys_sketch"),
    )


def read_sketches(slices: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Slices or merged slices with n_keys and, by name, quantiles (null without values) in place of the sketches."""
    read = {name: F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("values_sketch", F.lit(float(q)))) for name, q in quantiles.items()}
    return slices.withColumns({"n_keys": F.hll_sketch_estimate("keys_sketch"), **read}).drop("values_sketch", "keys_sketch")
