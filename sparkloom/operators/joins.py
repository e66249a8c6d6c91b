"""As-of and range joins without a product of the sides."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], split: Callable[[Column], Column] | None = None, long_rows: int = 1_000_000
) -> DataFrame:
    """Each left row with the columns of the last right row of the same key at or before its time (null if there is none).

    Both sides become one sorted stream per key, so it is one shuffle and one sort and no row meets another but its
    neighbours. split, a function that doesn't fall with time (such as its month), cuts the streams of keys with over
    long_rows rows, which are counted first: each part is sorted alone, and takes the last right row of the parts before it from a
    table of one row for each key and part. Other keys are joined as without it.

    A null key or time equals and precedes nothing: such left rows stay, with nulls, and don't enter the shuffle; such
    right rows count for nothing. Of right rows with equal times the one with the greatest columns counts. Repeated left rows each
    stay. A column of left that is named as a picked one gives way to it.
    """
    there = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.lit(True))
    timed, known = left.where(there & F.col(left_time).isNotNull()), right.where(there & F.col(right_time).isNotNull())
    kept = [c for c in left.columns if c not in columns]
    kinds = right.select(*columns).schema
    without = left.where(~there | F.col(left_time).isNull()).select(*kept, *(F.lit(None).cast(kinds[c].dataType).alias(c) for c in columns))
    if split is None:
        return _asof(timed, known, by, left_time, right_time, columns, kept, None).unionByName(without)
    rows = timed.groupBy(*by).count().unionByName(known.groupBy(*by).count())
    long = rows.groupBy(*by).agg(F.sum("count").alias("_n")).where(F.col("_n") > long_rows).select(*by)
    if long.isEmpty():
        return _asof(timed, known, by, left_time, right_time, columns, kept, None).unionByName(without)
    ends = [(_asof(timed.join(long, by, how), known.join(long, by, how), by, left_time, right_time, columns, kept, part)) for how, part in (("left_anti", None), ("left_semi", split))]
    return ends[0].unionByName(ends[1]).unionByName(without)


def _asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], kept: list[str], split: Callable[[Column], Column] | None) -> DataFrame:
    """asof_join of rows with keys and times."""
    picked = F.struct(F.col(right_time).alias("_at"), *columns)
    part = split or (lambda time: F.lit(0))
    kinds = {"_left": left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType, "_right": right.select(picked.alias("x")).schema["x"].dataType}
    lefts = left.select(*by, F.col(left_time).alias("_time"), part(F.col(left_time)).alias("_part"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kinds["_right"]).alias("_right"))
    rights = right.select(*by, F.col(right_time).alias("_time"), part(F.col(right_time)).alias("_part"), F.lit(0).alias("_side"), F.lit(None).cast(kinds["_left"]).alias("_left"), picked.alias("_right"))
    stream = lefts.unionByName(rights)
    order = Window.partitionBy(*by, "_part").orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = stream.withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    if split:
        parts = stream.groupBy(*by, "_part").agg(F.max("_right").alias("_last"))
        earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carried = parts.select(*by, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
        joined = joined.join(carried, [*by, "_part"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return joined.select(*(F.col(f"_left.{c}").alias(c) for c in kept), *(F.col(f"_found.{c}").alias(c) for c in columns))


def _cell(at: Column, size: Column) -> Column:
    """The cell of a whole number, exact for any of 64 bits."""
    return F.call_function("div", at - F.pmod(at, size), size)


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of points and spans with start <= point < end, by whole-number columns.

    Spans are listed once for each cell that they touch, points fall in one cell, and the cells are joined by hash.
    Cells are width wide for spans up to that length, and four times as wide on each level above, so a span touches five
    cells at most, whatever its length; points are listed once for each level that spans have.

    Null points and spans with a null end or without length match nothing; repeated rows match each on their own; columns that
    both sides have come out twice, as with a plain join.
    """
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log(length / width) / math.log(4))).cast("int")
    leveled = spans.where(F.col(end) > F.col(start)).withColumn("_level", level)
    levels = sorted(r[0] for r in leveled.groupBy("_level").count().collect())  # as many as a whole number has pairs of bits
    size = F.lit(width) * F.pow(F.lit(4), F.col("_level")).cast("bigint")
    cells = leveled.withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), size), _cell(F.col(end) - 1, size))))
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", _cell(F.col(point), size))
    return placed.join(cells, ["_level", "_cell"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_level", "_cell")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, by: list[str] | None = None) -> DataFrame:
    """Pairs of a left and a right span, start <= x < end in whole numbers, that have a number in common; each pair once.

    Each span has a level, by its length: cells of level k are width * 4**k wide and no shorter than the span, so a span touches two
    cells of its level, or of any higher one, at most. Two spans meet at the higher of their levels, in the cell in which their
    common part begins; there is one such cell, so no pair comes twice and nothing has to be made distinct. A span is listed
    at its own level, and at the higher levels that spans of the other side have, not at lower ones; by names columns that
    must also be equal, which the cells are then hashed with.

    Spans that only touch don't overlap; spans with a null end or key, and those without length, match nothing. Repeated rows
    match each on their own. The columns of both sides but by come out; those that both have come out twice, as with a plain join.
    """
    by = by or []
    (left_start, left_end), (right_start, right_end) = left_span, right_span

    def leveled(df: DataFrame, start: str, end: str) -> DataFrame:
        length = F.col(end) - F.col(start)
        return df.where(F.col(end) > F.col(start)).withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log(length / width) / math.log(4))).cast("int"))

    lefts, rights = leveled(left, left_start, left_end), leveled(right, right_start, right_end)
    levels = [sorted(r[0] for r in x.groupBy("_own").count().collect()) for x in (lefts, rights)]  # as many as a whole number has pairs of bits
    size = F.lit(width) * F.pow(F.lit(4), F.col("_level")).cast("bigint")

    def listed(df: DataFrame, start: str, end: str, others: list[int]) -> DataFrame:
        higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > F.col("_own"))
        at = df.withColumn("_level", F.explode(F.concat(F.array("_own"), higher)))
        return at.withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), size), _cell(F.col(end) - 1, size))))

    one = listed(lefts, left_start, left_end, levels[1]).withColumnsRenamed({"_own": "_left_own", left_start: "_left_start", left_end: "_left_end"})
    two = listed(rights, right_start, right_end, levels[0]).withColumnsRenamed({"_own": "_right_own", right_start: "_right_start", right_end: "_right_end"})
    begin = F.greatest("_left_start", "_right_start")
    meet = (begin < F.least("_left_end", "_right_end")) & (F.col("_level") == F.greatest("_left_own", "_right_own")) & (F.col("_cell") == _cell(begin, size))
    pairs = one.join(two, [*by, "_level", "_cell"]).where(meet).drop("_level", "_cell", "_left_own", "_right_own")
    return pairs.withColumnsRenamed({"_left_start": left_start, "_left_end": left_end}).withColumnsRenamed({"_right_start": right_start, "_right_end": right_end})
