"""Numbers and running values along an order, without the whole order, or a key's whole share of it, in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS_AT_MOST = 256  # cuts become an expression of the plan


def slices(df: DataFrame, by: str) -> Column:
    """Which slice of the order `by` (a number, date or timestamp) a row is in, ascending, null first. Cuts are quantiles over all rows,
    as many as shuffles have partitions; rows equal in `by` share a slice. Reads that column of df once."""
    spark = df.sparkSession
    n = min(PARTS_AT_MOST, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(by, [(k + 1) / n for k in range(n - 1)], 10_000).alias("q")).first().q if n > 1 else None
    cuts = sorted(set(found or ()))

    def tree(lo: int, hi: int) -> Column:
        """The number of cuts that are at most the value, by bisection."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(by).isNull(), -1).otherwise(tree(0, len(cuts)))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: the row's number from 0 along `order`, which tells all rows apart; its first column is a number, date or timestamp. Each
    slice is numbered by itself, beginning after the rows of the slices before it; only the slices' counts are summed up along the order."""
    rows = df.withColumn("__slice", slices(df, order[0]))
    counts = rows.groupBy("__slice").agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))  # PARTS_AT_MOST rows
    starts = counts.select("__slice", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    out = rows.withColumn(name, own).join(F.broadcast(starts), "__slice")  # as long as PARTS_AT_MOST
    return out.select(*df.columns, (F.col(name) + F.col("__before")).alias(name))


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, of: Callable[[Column], Column], plus: Callable[[Column, Column], Column], name: str, itself: bool = True) -> DataFrame:
    """Adds name: `of` (an aggregate such as F.sum or F.max, with `plus` to put two of its results together) of `value` over the key's
    rows so far along `order`, the row itself included or not.

    A key's rows are cut into slices of the order: totals of (key, slice) are summed up along the slices, and within a slice the window
    begins from what came before. So a key that holds a large part of all rows is spread over as many tasks as there are slices."""
    rows = df.withColumn("__key", F.struct(*keys)).withColumn("__slice", slices(df, order[0])).withColumn("__value", value)
    along = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("__key", "__slice").agg(of(F.col("__value")).alias("__total")).select("__key", "__slice", of(F.col("__total")).over(along).alias("__carried"))
    within = Window.partitionBy("__key", "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    out = rows.withColumn("__own", of(F.col("__value")).over(within)).join(carried, ["__key", "__slice"])
    both = F.when(F.col("__own").isNull(), F.col("__carried")).when(F.col("__carried").isNull(), F.col("__own")).otherwise(plus(F.col("__own"), F.col("__carried")))
    return out.select(*df.columns, both.alias(name))
