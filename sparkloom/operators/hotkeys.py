"""A join whose hot keys are measured first and salted, and no others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def hot_keys(df: DataFrame, on: list[str], share: float, sample: int = 100_000) -> DataFrame:
    """Keys (without nulls) that hold at least a share of the rows, as a sample of about so many rows has them: at most 1 / share rows.

    The sample only finds keys that are worth salting: a key that it misses is joined as any other, with the same rows.
    """
    n = df.count()
    drawn = df.select(*on).dropna().sample(min(1.0, sample / max(1, n)), seed=1) if n > sample else df.select(*on).dropna()
    counted = drawn.groupBy(*on).agg(F.count("*").alias("_n"))
    rows = counted.orderBy(F.desc("_n")).limit(int(1 / share)).collect()  # bounded by the share
    least = share * min(n, sample)
    return df.sparkSession.createDataFrame([tuple(r[c] for c in on) for r in rows if r["_n"] >= least], df.select(*on).schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: float = 0.01, salts: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """left joined to right on equal columns (inner, left, left_semi or left_anti), as left.join(right, on, how) gives.

    Left rows of hot keys are dealt over so many salts, and only for those keys each right row is repeated once a salt, so what
    is shuffled grows by few rows and no task gets all of a hot key. Meant for right sides that aren't themselves long
    in a hot key. hot: the keys, if they are known; measured by hot_keys otherwise. Its rows are at most 1 / share, and are broadcast.

    The salt is a hash of the left row, so a task that runs again deals its rows as before; rows alike in all columns share one.
    Null keys match nothing, as ever; where left rows without a match stay, rows with null keys are dealt over the salts
    too. Repeated rows join each with each. Columns other than on that both sides have come out twice, as with a plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: rows of the right side would come out once a salt")
    hot = (hot_keys(left, on, share) if hot is None else hot).select(*on).distinct().withColumn("_hot", F.lit(True))
    null_key = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))
    by_row = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot") | null_key, by_row).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")
