"""The driver's tables as the engine's inputs: samples, updates, buckets, metric events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.time import nanos_of, seconds_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, seq, seconds, nanos, value): one sample for each event, its user being the source."""
    return _samples(table(spark, sf_dir, "events"))


def _samples(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("EV:"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("seq"), seconds_of("ts").alias("seconds"), nanos_of("ts").alias("nanos"), "value")


SAMPLES = """samples AS (SELECT 'EV:' || user_id AS source, event_id AS seq, epoch_us(ts) // 1000000 AS seconds,
  CAST(epoch_us(ts) % 1000000 * 1000 AS INT) AS nanos, epoch_us(ts) * 1000 AS t, value, event_type, props FROM events)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, seconds, nanos, qty, price, disc): one table update for each order; the last array is one shorter than the others."""
    li = table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", seconds_of("l_shipdate").alias("s"))
    per = li.groupBy(F.col("l_orderkey").alias("root")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    of = lambda f: F.transform("r", lambda x: x.getField(f))
    disc = F.slice(of("l_discount"), 1, F.greatest(F.size("r") - 1, F.lit(0)))
    return per.select("root", of("s").alias("seconds"), of("l_linenumber").cast("array<bigint>").alias("nanos"), of("l_quantity").alias("qty"), of("l_extendedprice").alias("price"), disc.alias("disc"))


UPDATES = """li AS (SELECT l_orderkey AS root, epoch_us(l_shipdate) // 1000000 AS s, CAST(l_linenumber AS BIGINT) AS ns, l_quantity, l_extendedprice, l_discount,
  row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate))"""


def buckets(spark: SparkSession, sf_dir: str, days: tuple[int, int] | None = None) -> DataFrame:
    """(pvname, bucket_seq, ts_list, clock, values): a user's events of a day; even days as a list, odd ones as a sampling clock; every
    seventh even day's list is empty. bucket_seq is the response order, which isn't that of time. days: from the first to the last that is
    wanted, as days from 1970; the scan gets them as a range of times."""
    within = F.lit(True)
    if days:
        at = lambda d: F.lit(datetime(1970, 1, 1) + timedelta(days=d)).cast("timestamp_ntz")
        within = (F.col("ts") >= at(days[0])) & (F.col("ts") < at(days[1] + 1))
    e = _samples(table(spark, sf_dir, "events").where(within)).withColumn("day", F.floor(F.col("seconds") / 86400))
    at = F.struct(F.col("seconds").alias("epoch_seconds"), F.col("nanos").alias("nanoseconds"))
    per = e.groupBy(F.col("source").alias("pvname"), "day").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "seq", "value"))).alias("r"))
    even = F.col("day") % 2 == 0
    ts = F.transform("r", lambda x: x.at)
    clock = F.struct(F.col("r")[0].at.epoch_seconds.alias("epoch_seconds"), F.col("r")[0].at.nanoseconds.alias("nanoseconds"), (F.lit(250_000_000) + F.size("r")).cast("long").alias("period_ns"), F.size("r").alias("count"))
    return per.select(
        "pvname",
        F.pmod(F.col("day") * 7919, F.lit(1009)).alias("bucket_seq"),
        F.when(even, F.when(F.col("day") % 7 == 0, F.slice(ts, 1, 0)).otherwise(ts)).alias("ts_list"),
        F.when(~even, clock).alias("clock"),
        F.transform("r", lambda x: x.value).alias("values"),
    )


BUCKETS = SAMPLES + """, per AS (SELECT source AS pvname, seconds // 86400 AS day, min(t) AS t0, max(t) AS t1, count(*) AS n FROM samples GROUP BY ALL),
buckets AS (SELECT pvname, day, (day * 7919) % 1009 AS bucket_seq, n, CASE WHEN day % 2 = 1 THEN 'clock' ELSE 'list' END AS kind,
  CASE WHEN day % 2 = 1 THEN t0 WHEN day % 7 <> 0 THEN t0 END AS first_ns,
  CASE WHEN day % 2 = 1 THEN t0 + (n - 1) * (250000000 + n) WHEN day % 7 <> 0 THEN t1 END AS last_ns,
  CASE WHEN day % 2 = 1 THEN 250000000 + n END AS period FROM per)"""


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, reader, source, value, seq): readers are order priorities, sources order states."""
    o = table(spark, sf_dir, "orders")
    names = F.element_at(F.array(F.lit("pushes_total"), F.lit("payload_bytes_total"), F.lit("throughput_bytes_per_second")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    reader = F.when(F.pmod("o_custkey", F.lit(4)) != 0, F.col("o_orderpriority"))
    return o.select(names.alias("name"), reader.alias("reader"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))


METRICS = """metrics AS (SELECT ['pushes_total', 'payload_bytes_total', 'throughput_bytes_per_second'][o_orderkey % 3 + 1] AS name,
  CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END AS reader, o_orderstatus AS source, o_totalprice AS value, o_orderkey AS seq FROM orders)"""
