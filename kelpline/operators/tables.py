"""Table updates: structs of equal-length arrays, of which two hold each row's seconds and nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_times(top_s: Column, top_n: Column, value_s: Column, value_n: Column) -> tuple[Column, Column]:
    """The pair of time arrays: both from the top level, or else both from the value; never one from each."""
    top = top_s.isNotNull() & top_n.isNotNull()
    inner = value_s.isNotNull() & value_n.isNotNull()
    pick = lambda a, b: F.when(top, a.cast("array<bigint>")).when(inner, b.cast("array<bigint>"))
    return pick(top_s, value_s), pick(top_n, value_n)


def row_count(seconds: Column, nanos: Column) -> Column:
    """Rows of an update: the shorter of the two time arrays; null, the update fails, if that is empty or one is missing."""
    n = F.least(F.size(seconds), F.size(nanos))
    return F.when(seconds.isNotNull() & nanos.isNotNull() & (n > 0), n)


def cell_value(cells: Column) -> Column:
    """Compound cells (value, raw): the nested value where it is set, else the cell itself."""
    return F.transform(cells, lambda x: F.coalesce(x.getField("value"), x.getField("raw")))


def unpivot(updates: DataFrame, keys: list[str], columns: list[str], seconds: str, nanos: str, with_times: bool = False) -> DataFrame:
    """(keys, source, col_pos, pos, seconds, nanos, value): each column of an update becomes a source with the update's times.

    A column gives as many rows as it has values, the update's row count at most: arrays are cut before they are zipped, since zipping
    would pad. Time columns are sources only if `with_times`. An update without row count gives none."""
    n = row_count(F.col(seconds), F.col(nanos))
    cols = [*columns, *([seconds, nanos] if with_times else [])]
    each = F.array(*[F.struct(F.lit(c).alias("source"), F.lit(i).alias("col_pos"), F.col(c).cast("array<double>").alias("v")) for i, c in enumerate(cols)])
    rows = updates.withColumn("__n", n).where("__n is not null").select(*keys, "__n", F.col(seconds).alias("__s"), F.col(nanos).alias("__ns"), F.inline(each))
    rows = rows.withColumn("__m", F.least("__n", F.size("v"))).where("__m > 0")
    zipped = F.arrays_zip(F.slice("__s", 1, F.col("__m")).alias("s"), F.slice("__ns", 1, F.col("__m")).alias("ns"), F.slice("v", 1, F.col("__m")).alias("v"))
    out = rows.select(*keys, "source", "col_pos", F.posexplode(zipped).alias("pos", "x"))
    return out.select(*keys, "source", "col_pos", "pos", F.col("x.s").cast("long").alias("seconds"), F.col("x.ns").cast("int").alias("nanos"), F.col("x.v").alias("value"))


def column_batches(emitting: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, source, col_pos) of emitting columns. Adds batch: the k-th of an update is in batch k / size; size 0 puts all in batch 0."""
    if size <= 0:
        return emitting.withColumn("batch", F.lit(0).cast("long"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("col_pos")) - 1
    return emitting.withColumn("batch", F.floor(k / size).cast("long"))


def statistics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns `base.STAT` as rows (keys, base, Val, CNT, RMS, AVG, MIN, MAX), one for each base name."""
    stats = ["Val", "CNT", "RMS", "AVG", "MIN", "MAX"]
    bases = sorted({n.rpartition(".")[0] for n in names if n.rpartition(".")[2] in stats})
    col = lambda b, s: (F.col(f"`{b}.{s}`").cast("double") if f"{b}.{s}" in names else F.lit(None).cast("double")).alias(s)
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(b).alias("base"), *[col(b, s) for s in stats]) for b in bases])))
