"""Buckets of samples: time ranges, metadata of sources, and windowed retrieval of all sources or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.time import NANOS, instant


def list_range(ts_list: Column) -> tuple[Column, Column]:
    """First and last instant of a list of (epoch_seconds, nanoseconds), sorted or not; null for an empty one."""
    return F.array_min(ts_list), F.array_max(ts_list)


def clock_end(seconds: Column, nanos: Column, period_ns: Column, count: Column) -> Column:
    """The last instant of a sampling clock: start + (count - 1) * period with carry; the start itself if there is one sample or no period."""
    steps = F.when((count > 1) & (period_ns > 0), (count - 1).cast("decimal(38,0)") * period_ns.cast("decimal(20,0)")).otherwise(F.lit(0))
    total = nanos.cast("decimal(38,0)") + steps
    carry = F.floor(total / F.lit(NANOS).cast("decimal(20,0)")).cast("long")
    return instant(seconds + carry, (total - carry.cast("decimal(20,0)") * NANOS).cast("int"))


def with_range(buckets: DataFrame) -> DataFrame:
    """buckets (ts_list, clock). Adds first and last; both null where the bucket has no timestamps."""
    lo, hi = list_range(F.col("ts_list"))
    c = F.col("clock")
    start = instant(c.getField("epoch_seconds"), c.getField("nanoseconds"))
    end = clock_end(c.getField("epoch_seconds"), c.getField("nanoseconds"), c.getField("period_ns"), c.getField("count"))
    return buckets.withColumn("first", F.coalesce(lo, F.when(c.isNotNull(), start))).withColumn("last", F.coalesce(hi, F.when(c.isNotNull(), end)))


def in_sources(buckets: DataFrame, sources: DataFrame) -> DataFrame:
    """Buckets of requested, non-empty names."""
    return buckets.where(F.col("pvname") != "").join(sources.select("pvname").distinct(), "pvname", "left_semi")


def source_metadata(buckets: DataFrame) -> DataFrame:
    """(pvname, first, last, num_buckets): the range over buckets that have timestamps, the count over all."""
    return with_range(buckets).groupBy("pvname").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("num_buckets"))


def last_bucket(buckets: DataFrame) -> DataFrame:
    """(pvname, last_count, last_type, last_period): of the last bucket in response order with a known range; the period is that of the last
    clock bucket, which a later list bucket leaves in place."""
    rows = with_range(buckets).withColumn("n", F.when(F.col("clock").isNotNull(), F.col("clock.count")).otherwise(F.size("ts_list")))
    rows = rows.withColumn("kind", F.when(F.col("clock").isNotNull(), "clock").otherwise("list"))
    known = F.when(F.col("first").isNotNull(), F.col("bucket_seq"))
    clock = F.when(F.col("clock").isNotNull(), F.col("bucket_seq"))
    return rows.groupBy("pvname").agg(F.max_by("n", known).cast("int").alias("last_count"), F.max_by("kind", known).alias("last_type"), F.max_by("clock.period_ns", clock).alias("last_period"))


def normalise_metadata(info: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """Answers of the metadata call: empty strings and numbers of zero or less count as absent; num_buckets is always set."""
    out = info
    for c in texts:
        out = out.withColumn(c, F.nullif(F.col(c), F.lit("")))
    for c in numbers:
        out = out.withColumn(c, F.when(F.col(c) > 0, F.col(c)))
    return out.withColumn("num_buckets", F.coalesce("num_buckets", F.lit(0)))


def sources_data(buckets: DataFrame, sources: list[str], now_s: int, lookback_s: int = 30, forward_s: int = 1) -> DataFrame:
    """(pvname, bucket_seq, n_values): the buckets with values that begin in [now - lookback, now + forward), if every requested source has one;
    else no rows at all. An empty request gives no rows; an empty name can't be met. Bucket boundaries stay."""
    spark = buckets.sparkSession
    wanted = spark.createDataFrame([(s,) for s in sorted(set(sources))], "pvname string")
    begin, end = now_s - lookback_s, now_s + forward_s
    rows = with_range(buckets).where((F.col("first.epoch_seconds") >= begin) & (F.col("first.epoch_seconds") < end) & (F.size("values") > 0))
    rows = in_sources(rows, wanted)
    # One row with the number of sources found gates all others.
    gate = rows.select("pvname").distinct().agg(F.count("*").alias("found")).where(F.col("found") == len(set(sources)))
    return rows.select("pvname", "bucket_seq", F.size("values").alias("n_values")).join(F.broadcast(gate), F.lit(True), "left_semi")


def sources_info(answer: DataFrame | None, status: str, buckets: DataFrame, sources: list[str], now_s: int, message: str = "") -> DataFrame:
    """(pvname, first, last, num_buckets, last_count, last_type, last_period) of the requested sources, by what the metadata call came to.

    OK: its answer (those columns), where empty texts and counts of zero count as absent. UNIMPLEMENTED, or a message that the method wasn't
    found: from the buckets that begin in [0, now + 1 s) or have no time at all. Any other status: no rows, as for an empty request."""
    spark = buckets.sparkSession
    wanted = sorted({s for s in sources if s})
    columns = ["pvname", "first", "last", "num_buckets", "last_count", "last_type", "last_period"]
    names = spark.createDataFrame([(s,) for s in wanted], "pvname string")
    if status == "OK" and answer is not None:
        rows = answer.join(names, "pvname", "left_semi")
        return normalise_metadata(rows, ["last_type"], ["last_count", "last_period"]).select(columns)
    rows = in_sources(buckets, names)
    if status != "UNIMPLEMENTED" and "Method not found" not in message:
        rows = rows.limit(0)
    ranged = with_range(rows)
    ranged = ranged.where(F.col("first").isNull() | (F.col("first.epoch_seconds") >= 0) & (F.col("first.epoch_seconds") < now_s + 1)).drop("first", "last")
    return source_metadata(ranged).join(last_bucket(ranged), "pvname").select(columns)
