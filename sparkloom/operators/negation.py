"""NOT IN with the semantics of SQL, without a nested loop."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F


def not_in(left: DataFrame, right: DataFrame, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """The rows of left for which (left_columns) NOT IN (SELECT right_columns FROM right) is true.

    A left row stays if no right row may equal it: in each right row some column has two values that are there and differ. So
    a right row without any value excludes every left row, a left row without any value stays only if right is empty, and a null in
    one column stands for any value there.

    Rows can only meet by the columns that both have values in. Right rows are therefore taken by which of their columns are null
    (2 ** columns kinds): each kind is an anti join on equal keys, where a key is which left columns are null and the
    values that both have, and a right row gives one key for each kind of left row. No pair is tried that doesn't share a key; Spark
    drops the joins of kinds without rows at run time. Meant for few columns.

    Repeated rows are each judged on their own; columns of left pass through; those of right matter only if named. Either
    table may be empty. Values compare as Spark's equality does: NaN equals NaN.
    """
    if len(left_columns) != len(right_columns) or not left_columns:
        raise ValueError("as many right columns as left columns, and one at least")
    n = len(left_columns)
    kinds = list(product((False, True), repeat=n))  # which columns are null

    def code(kind: tuple[bool, ...]) -> int:
        return sum(1 << i for i, null in enumerate(kind) if null)

    own = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(left_columns)), F.lit(0))
    kept = left.withColumn("_kind", own)
    for kind in kinds:
        there = [i for i in range(n) if not kind[i]]
        rows = right
        for i, c in enumerate(right_columns):
            rows = rows.where(F.col(c).isNull() if kind[i] else F.col(c).isNotNull())
        values = rows.select(*(F.col(right_columns[i]).alias(f"_r{i}") for i in there)).distinct() if there else rows.limit(1).select()
        others = F.array(*(F.struct(F.lit(code(k)).alias("kind"), *(F.when(F.lit(not k[i]), F.col(f"_r{i}")).alias(f"_r{i}") for i in there)) for k in kinds))
        keys = values.select(F.explode(others).alias("_key")).select("_key.*").distinct()
        same = kept["_kind"] == keys["kind"]
        for i in there:
            same &= kept[left_columns[i]].eqNullSafe(keys[f"_r{i}"])
        kept = kept.join(keys, same, "left_anti")
    return kept.drop("_kind")
