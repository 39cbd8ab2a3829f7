"""Exact global numbering and exact median, neither of which may sit in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweft.functions.text import to_number
from crossweft.session import durable

SINGLE_SORT_ROWS = 500_000


def global_row_number(
    df: DataFrame,
    keys: Sequence[tuple[str, bool]],
    name: str,
    single_sort_rows: int = SINGLE_SORT_ROWS,
    slices: int | None = None,
    n: int | None = None,
) -> DataFrame:
    """Number rows 1..n by ``keys`` (column, ascending); the keys must be unique together.

    ``n``, when the caller knows it, is the number of rows or an upper bound of it.

    A small input is sorted in one task. A large one is dealt into key ranges of about
    ``single_sort_rows`` rows, numbered inside each range, and shifted by the counts of the
    ranges before it. The ranges are stored before they are counted, so a task that is run
    again cannot cut them differently.
    """
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]
    n = df.count() if n is None else n
    if n <= single_sort_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))

    dealt = _in_ranges(df, order, slices or n // single_sort_rows + 2)
    counts = dealt.groupBy("__slot").count()
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slot").orderBy(*order))
    return (
        dealt.join(offsets, "__slot")
        .withColumn(name, (inside + F.col("__before")).cast("bigint"))
        .drop("__slot", "__before")
    )


def _in_ranges(df: DataFrame, order: Sequence[Column], slices: int) -> DataFrame:
    """``df`` with ``__slot``, the number of the key range that a row lies in; stored."""
    return durable(df.repartitionByRange(slices, *order).withColumn("__slot", F.spark_partition_id()))


def exact_medians(
    df: DataFrame, columns: Sequence[str], collect_rows: int = SINGLE_SORT_ROWS
) -> dict[str, float | None]:
    """Medians of several columns: one scan when the table is small, else one by one."""
    numbers = df.select(*[to_number(F.col(c)).alias(c) for c in columns])
    if numbers.limit(collect_rows + 1).count() <= collect_rows:
        return numbers.agg(*[F.median(c).alias(c) for c in columns]).first().asDict()
    return {c: exact_median(df, F.col(c), collect_rows) for c in columns}


def exact_median(df: DataFrame, column: Column, collect_rows: int = SINGLE_SORT_ROWS) -> float | None:
    """Median of the readable values.

    ``percentile`` keeps every distinct value in one buffer, so it only runs on a
    bracket known to be small: the two middle ranks are trapped between
    approximate quantiles, everything below is counted, and the bracket shrinks
    until it fits.
    """
    values = df.select(to_number(column).alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        return None
    if n <= collect_rows:
        return values.agg(F.median("v")).first()[0]
    ranks = sorted({(n - 1) // 2, n // 2})
    below, inside, lo, hi = 0, n, None, None
    while inside > collect_rows:
        span = values if lo is None else values.where(F.col("v").between(lo, hi))
        first = (ranks[0] - below) / inside
        last = (ranks[-1] - below) / inside
        lo, hi = span.approxQuantile(
            "v", [max(0.0, first - 0.002), min(1.0, last + 0.002)], 0.001
        )
        before = inside
        below, inside = values.agg(
            F.count(F.when(F.col("v") < lo, 1)),
            F.count(F.when(F.col("v").between(lo, hi), 1)),
        ).first()
        if inside > before // 2:
            break  # repeats of a few values fill the bracket; grouping removes them
    span = values if lo is None else values.where(F.col("v").between(lo, hi))
    # Values repeat, or the bracket is small: order the distinct ones, range by range.
    counted = durable(span.groupBy("v").count())
    dealt = _in_ranges(counted, [F.col("v").asc()], counted.count() // collect_rows + 1)
    sums = sorted((r["__slot"], r["n"]) for r in dealt.groupBy("__slot").agg(F.sum("count").alias("n")).collect())
    hits = []
    for rank in ranks:
        left = rank - below
        slot = None
        for slot, size in sums:
            if left < size:
                break
            left -= size
        upto = F.sum("count").over(Window.orderBy("v"))
        part = dealt.where(F.col("__slot") == slot).select("v", upto.alias("upto"))
        hits.append(part.where(F.col("upto") > left).agg(F.min("v")).first()[0])
    return float(sum(hits) / len(hits))
