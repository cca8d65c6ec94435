"""Counters, gauges, histograms, and the reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import format_bytes, plain_number
from kelpline.operators.numbering import running

#: The upper bounds of the two histograms.
PROCESSING_MS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
SEND_SECONDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy("name", *labels).agg(F.sum("value").alias("value"))


def gauges(events: DataFrame, labels: list[str], seq: str = "seq") -> DataFrame:
    """The last value written wins."""
    return events.groupBy("name", *labels).agg(F.max_by("value", seq).alias("value"))


def histogram(observations: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(labels, le, count, total_sum, total_count): cumulative buckets, upper bounds included, `+Inf` last. Each observation is looked at
    once; it is counted in its own bucket and the buckets are then summed up."""
    at = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        at = F.when(F.col(value) <= bounds[k], k).otherwise(at)
    n = observations.where(F.col(value).isNotNull()).groupBy(*labels, at.alias("b")).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    per = n.groupBy(*labels).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sum("s").alias("total_sum"), F.sum("n").alias("total_count"))
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(le).alias("le")) for k, le in enumerate([*map(str, bounds), "+Inf"])])
    rows = per.select(*labels, "m", "total_sum", "total_count", F.inline(names))
    upto = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return rows.select(*labels, "le", upto.alias("count"), "total_sum", "total_count")


def totals(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.sum("pushes").alias("pushes"), F.sum("bytes").alias("bytes"), F.sum("rate").alias("rate"))


def snapshot(metrics: DataFrame) -> DataFrame:
    """metrics (name, reader, source, value, seq): (label, pushes, bytes, rate). The label is the reader, else the source; what is missing
    is 0; of repeated lines the last counts."""
    label = F.coalesce(F.nullif("reader", F.lit("")), F.nullif("source", F.lit("")))
    of = lambda n: F.coalesce(F.max_by("value", F.when(F.col("name") == n, F.col("seq"))), F.lit(0.0))
    rows = metrics.withColumn("label", label).where(F.col("label").isNotNull())
    return rows.groupBy("label").agg(of("pushes_total").alias("pushes"), of("payload_bytes_total").alias("bytes"), of("throughput_bytes_per_second").alias("rate"))


def pool_snapshot(metrics: DataFrame) -> DataFrame:
    """metrics (name, pool, value, seq): (pool, in_use, available) of each connection pool, the last reading of each; what is missing is 0.
    Pools are rows of their own, and one row with null pool sums them up, so that none hides another."""
    of = lambda n: F.coalesce(F.max_by("value", F.when(F.col("name") == n, F.col("seq"))), F.lit(0.0)).cast("long")
    rows = metrics.where(F.col("pool").isNotNull() & F.col("name").isin("pool_connections_in_use", "pool_connections_available"))
    each = rows.groupBy("pool").agg(of("pool_connections_in_use").alias("in_use"), of("pool_connections_available").alias("available"))
    return each.unionByName(each.agg(F.lit(None).cast("string").alias("pool"), F.coalesce(F.sum("in_use"), F.lit(0)).alias("in_use"), F.coalesce(F.sum("available"), F.lit(0)).alias("available")))


#: What a scan of a process reads, and the gauge that each is kept in.
PROCESS_GAUGES = {
    "vm_size": "process_memory_virtual_bytes",
    "vm_rss": "process_memory_rss_bytes",
    "vm_peak": "process_memory_virtual_peak_bytes",
    "rss_anon": "process_memory_rss_anon_bytes",
    "rss_file": "process_memory_rss_file_bytes",
    "rss_shmem": "process_memory_rss_shmem_bytes",
    "total_rss": "process_memory_rss_total_bytes",
    "num_fds": "process_fds_open",
    "num_threads": "process_threads",
    "priority": "process_priority",
    "nice": "process_nice",
}


def process_gauges(scans: DataFrame, labels: list[str], seq: str = "seq") -> DataFrame:
    """scans (labels, seq, and the keys of PROCESS_GAUGES but total_rss), a row for each scan of a process: (labels, name, value), a row for
    each gauge ever set. A reading that a scan lacks leaves its gauge as it was. The total is the sum of those of the scan's three
    resident parts that it has, and absent if it has none."""
    parts = [F.col(c) for c in ("rss_anon", "rss_file", "rss_shmem")]
    total = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    rows = scans.withColumn("total_rss", total)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).cast("double").alias(c) for c in PROCESS_GAUGES]
    pairs = F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for c, name in PROCESS_GAUGES.items()]))
    return rows.groupBy(*labels).agg(*last).select(*labels, pairs).where("value is not null")


def report(rows: DataFrame) -> DataFrame:
    """A snapshot as lines of text for people."""
    line = F.concat("label", F.lit(": "), F.format_string("%.0f", F.rint("pushes")), F.lit(" pushes, "), format_bytes("bytes"), F.lit(", "), format_bytes("rate"), F.lit("/s"))
    return rows.select("label", line.alias("line"))


def throughput(items: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes a second of each key's last item that took any time."""
    rate = F.col("bytes") * 1000.0 / F.col("elapsed_ms")
    return items.where(F.col("elapsed_ms") > 0).groupBy(*keys).agg(F.max_by(rate, F.col("seq")).alias("bytes_per_second"))


def drop_rate(events: DataFrame, keys: list[str]) -> DataFrame:
    """What was received and never processed."""
    n = lambda k: F.sum(F.when(F.col("name") == k, F.col("value")).otherwise(0))
    return events.groupBy(*keys).agg(n("received").alias("received"), n("processed").alias("processed")).withColumn("dropped", F.col("received") - F.col("processed"))


def counter_deltas(readings: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """What a cumulative reading grew by since the one before; a smaller reading is a restart and counts whole; the first too."""
    rows = running(readings, keys, [seq], F.struct(seq, value), F.max, F.greatest, "__last", itself=False)
    before = F.col("__last")[value]
    return rows.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before)).drop("__last")


def queue_depth(changes: DataFrame, keys: list[str], seq: str, step: Column) -> DataFrame:
    """The running depth after each enqueue (+1) and dequeue (-1)."""
    return running(changes, keys, [seq], step, F.sum, lambda a, b: a + b, "depth")


def exposition(metrics: DataFrame) -> DataFrame:
    """(name, labels map, value) as lines of exposition text; quotes, backslashes and line ends in labels are escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit('="'), escaped(e.value), F.lit('"')))
    label = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.select(F.concat("name", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


def base_name(name: Column) -> tuple[Column, Column]:
    """A metric's base name and which field of a histogram it is: bucket, sum, count, or none."""
    field = F.regexp_extract(name, "_(bucket|sum|count)$", 1)
    return F.regexp_replace(name, "_(bucket|sum|count)$", ""), F.nullif(field, F.lit(""))


def json_groups(metrics: DataFrame) -> DataFrame:
    """metrics (name, source, value): (base, n, members): one JSON list for each base name, in order of field and source. Names of labels are
    escaped by the writer; numbers that aren't finite become strings, others are written as SQL has them, whatever their size."""
    base, field = base_name(F.col("name"))
    rows = metrics.select(base.alias("base"), F.struct(F.coalesce(field, F.lit("")).alias("histogram"), F.col("source"), F.col("value")).alias("m"))
    texts = F.transform(F.transform(F.array_sort(F.collect_list("m")), lambda m: F.to_json(m)), _plain_value)
    return rows.groupBy("base").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("members"))


def _plain_value(member: Column) -> Column:
    """A member's JSON, in which the value is last; only a number has no quote there, and only one with an exponent is written anew."""
    number = F.regexp_extract(member, r"(-?\d\.\d+E-?\d+)\}$", 1)
    head = F.substring(member, F.lit(1), F.length(member) - F.length(number) - 1)
    return F.when(number == "", member).otherwise(F.concat(head, plain_number(number), F.lit("}")))
