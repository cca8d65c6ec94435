"""Queries of ordered operators, buckets, metrics, delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions.time import nanos_of, seconds_of
from kelpline.operators import buckets as bk
from kelpline.operators import delivery, metrics, windows
from kelpline.plans.inputs import BUCKETS, METRICS, SAMPLES, buckets, metric_events, samples, table

QUERIES, SQL = {}, {}
T0_MS = 1704067200000  # 2024-01-01


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_D = 6 * 3600 * 1_000_000_000


@query(f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM samples),
 f AS (SELECT source, n, t, t AS anchor, 0::BIGINT AS batch FROM o WHERE n = 1 UNION ALL
  SELECT o.source, o.n, o.t, CASE WHEN o.t < f.anchor OR o.t - f.anchor > {_D} THEN o.t ELSE f.anchor END,
   CASE WHEN o.t < f.anchor OR o.t - f.anchor > {_D} THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
 SELECT source, batch, min(t) AS first_ns, max(t) AS last_ns, count(*) AS n_samples FROM f GROUP BY ALL""")
def win_anchor_batches(spark, d):
    s = samples(spark, d).withColumn("t", windows.total_ns("seconds", "nanos"))
    s = windows.anchor_batches(s, ["source"], ["seq"], F.col("t"), _D)
    return s.groupBy("source", "batch").agg(F.min("t").alias("first_ns"), F.max("t").alias("last_ns"), F.count("*").alias("n_samples"))


_ARRIVAL = "(seq * 7919) % 10007"


@query(f"""WITH {SAMPLES}, o AS (SELECT source, seq, t, {_ARRIVAL} AS arrival FROM samples),
 m AS (SELECT *, max(t) OVER (PARTITION BY source ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM o)
 SELECT source, seq FROM m WHERE mark IS NULL OR t > mark""")
def win_highwater_dedup(spark, d):
    s = samples(spark, d).withColumn("t", windows.total_ns("seconds", "nanos")).withColumn("arrival", F.pmod(F.col("seq") * 7919, F.lit(10007)))
    return windows.highwater(s, ["source"], ["arrival", "seq"], F.col("t")).where("accepted").select("source", "seq")


@query(f"""WITH RECURSIVE {SAMPLES}, o AS (SELECT source, t // 1000000 AS a, 200 + 20 * (seq % 97) AS b, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM samples),
 f AS (SELECT source, n, seq, a AS start, b AS held, 0::BIGINT AS stream, b < 2048 AS is_open FROM o WHERE n = 1 UNION ALL
  SELECT source, n, seq, CASE WHEN new THEN a ELSE start END, CASE WHEN new THEN b ELSE held + b END, CASE WHEN new THEN stream + 1 ELSE stream END,
   NOT (CASE WHEN new THEN false ELSE a - start >= 86400000 END OR CASE WHEN new THEN b ELSE held + b END >= 2048)
  FROM (SELECT o.source, o.n, o.seq, o.a, o.b, f.start, f.held, f.stream, NOT f.is_open OR o.a - f.start >= 86400000 OR (f.held > 0 AND f.held + o.b > 2048) AS new
        FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1))
 SELECT source, seq, stream FROM f""")
def win_stream_rotation(spark, d):
    s = samples(spark, d).withColumn("a", F.floor(windows.total_ns("seconds", "nanos") / 1_000_000)).withColumn("b", 200 + 20 * F.pmod("seq", F.lit(97)))
    return windows.stream_rotation(s, ["source"], ["seq"], F.col("a"), F.col("b"), 86_400_000, 2048).select("source", "seq", "stream")


@query(f"""WITH {SAMPLES} SELECT source, seq, t - lag(t) OVER w AS gap, coalesce(t - lag(t) OVER w >= 43200000000000, false) AS idle_before FROM samples WINDOW w AS (PARTITION BY source ORDER BY seq)""")
def win_idle_rotation(spark, d):
    s = samples(spark, d).withColumn("t", windows.total_ns("seconds", "nanos"))
    return windows.idle_gaps(s, ["source"], ["seq"], F.col("t"), 43_200_000_000_000).select("source", "seq", "gap", "idle_before")


@query(f"WITH {SAMPLES} SELECT source, arg_max(value, t) AS value, arg_max(seq, t) AS seq FROM samples GROUP BY source")
def win_latest_value(spark, d):
    return windows.latest(samples(spark, d), ["source"], F.struct("seconds", "nanos"), "value", "seq")


def _polls(name, poll_ms, lookback_ms):
    contiguous = poll_ms == lookback_ms

    def run(spark, d):
        s = samples(spark, d).withColumn("ms", F.col("seconds") * 1000 + F.floor(F.col("nanos") / 1_000_000))
        newest = s.agg(F.max("ms")).first()[0]
        polls = 0 if newest is None else (newest - T0_MS) // poll_ms + 1  # until a window holds the newest sample
        hit = windows.window_samples(s, F.col("ms"), T0_MS + poll_ms, poll_ms, lookback_ms, polls)
        n = hit.groupBy("poll_id").agg(F.count("*").alias("n_samples"))
        w = windows.poll_windows(spark, T0_MS + poll_ms, poll_ms, lookback_ms, polls)
        return w.join(n, w.poll_id == n.poll_id, "left").select(w.poll_id, "from_ms", "to_ms", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))

    start = f"coalesce(lag(to_ms) OVER (ORDER BY poll_id), to_ms - {lookback_ms})" if contiguous else f"to_ms - {lookback_ms}"
    SQL[name] = f"""WITH {SAMPLES}, r AS (SELECT unnest(range((max(t) // 1000000 - {T0_MS}) // {poll_ms} + 1)) AS k FROM samples),
 p AS (SELECT CAST(k AS INT) AS poll_id, {T0_MS + poll_ms} + k * {poll_ms} AS to_ms FROM r),
 w AS (SELECT poll_id, {start} AS from_ms, to_ms FROM p)
 SELECT poll_id, from_ms, to_ms, (SELECT count(*) FROM samples WHERE t // 1000000 >= from_ms AND t // 1000000 < to_ms) AS n_samples FROM w"""
    QUERIES[name] = run


_polls("tail_windows_contiguous", 43_200_000, 43_200_000)
_polls("tail_windows_gapped", 43_200_000, 10_800_000)


@query(f"WITH {SAMPLES} SELECT source, seq, seconds, nanos, value FROM samples WHERE seconds >= 1704672000 AND seconds < 1704931200")
def src_archiver_window(spark, d):
    e = table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-08 00:00:00' and ts < timestamp_ntz'2024-01-11 00:00:00'")
    return e.select(F.concat(F.lit("EV:"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("seq"), seconds_of("ts").alias("seconds"), nanos_of("ts").alias("nanos"), "value")


def _ns(c):
    return F.col(f"{c}.epoch_seconds") * 1_000_000_000 + F.col(f"{c}.nanoseconds").cast("long")


@query(f"WITH {BUCKETS} SELECT pvname, bucket_seq, first_ns, last_ns FROM buckets WHERE kind = 'clock'")
def ts_range_clock(spark, d):
    b = bk.with_range(buckets(spark, d).where("clock is not null"))
    return b.select("pvname", "bucket_seq", _ns("first").alias("first_ns"), _ns("last").alias("last_ns"))


@query(f"WITH {BUCKETS} SELECT pvname, bucket_seq, first_ns, last_ns FROM buckets WHERE kind = 'list'")
def ts_range_list(spark, d):
    b = bk.with_range(buckets(spark, d).where("clock is null").withColumn("ts_list", F.reverse("ts_list")))
    return b.select("pvname", "bucket_seq", _ns("first").alias("first_ns"), _ns("last").alias("last_ns"))


@query(f"WITH {BUCKETS} SELECT pvname, bucket_seq FROM buckets WHERE pvname IN ('EV:1', 'EV:3', 'EV:5', 'EV:7')")
def query_source_filter(spark, d):
    wanted = spark.createDataFrame([("EV:1",), ("EV:3",), ("EV:5",), ("EV:7",), ("",)], "pvname string")
    return bk.in_sources(buckets(spark, d), wanted).select("pvname", "bucket_seq")


@query(f"WITH {BUCKETS} SELECT pvname, min(first_ns) AS first_ns, max(last_ns) AS last_ns, count(*) AS num_buckets FROM buckets GROUP BY pvname")
def agg_source_metadata(spark, d):
    return bk.source_metadata(buckets(spark, d)).select("pvname", _ns("first").alias("first_ns"), _ns("last").alias("last_ns"), "num_buckets")


@query(f"""WITH {BUCKETS} SELECT pvname, CAST(arg_max(n, bucket_seq) FILTER (WHERE first_ns IS NOT NULL) AS INT) AS last_count,
 arg_max(kind, bucket_seq) FILTER (WHERE first_ns IS NOT NULL) AS last_type, arg_max(period, bucket_seq) FILTER (WHERE kind = 'clock') AS last_period FROM buckets GROUP BY pvname""")
def agg_last_bucket(spark, d):
    return bk.last_bucket(buckets(spark, d))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS provider, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS period, CAST(s_suppkey % 5 AS BIGINT) AS num_buckets FROM supplier""")
def meta_normalise(spark, d):
    s = table(spark, d, "supplier")
    k = F.pmod("s_suppkey", F.lit(5))
    info = s.select("s_suppkey", F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "").otherwise(F.col("s_name")).alias("provider"), F.col("s_acctbal").alias("period"), F.when(k > 0, k).alias("num_buckets"))
    return bk.normalise_metadata(info, ["provider"], ["period"]).withColumn("num_buckets", F.col("num_buckets").cast("long"))


_NOW, _BACK = 1705276800, 3 * 86400
_DAYS = ((_NOW - _BACK) // 86400, (_NOW + 1) // 86400)  # buckets are of days
_DATA = f"""WITH {BUCKETS}, hit AS (SELECT pvname, bucket_seq, CAST(n AS INT) AS n_values FROM buckets
 WHERE pvname IN ({{names}}) AND first_ns // 1000000000 >= {_NOW - _BACK} AND first_ns // 1000000000 < {_NOW + 1})
 SELECT * FROM hit WHERE (SELECT count(DISTINCT pvname) FROM hit) = {{n}}"""


@query(_DATA.format(names="'EV:1', 'EV:2', 'EV:3'", n=3))
def query_sources_data(spark, d):
    return bk.sources_data(buckets(spark, d, _DAYS), ["EV:1", "EV:2", "EV:3"], _NOW, _BACK)


@query(_DATA.format(names="'EV:1', 'EV:2', 'EV:none'", n=3))
def query_sources_data_missing(spark, d):
    return bk.sources_data(buckets(spark, d, _DAYS), ["EV:1", "EV:2", "EV:none"], _NOW, _BACK)


_NAMES = [f"EV:{k}" for k in range(1, 60)]
_INFO = f"""WITH {BUCKETS}, wanted AS (SELECT 'EV:' || k AS pvname FROM range(1, 60) AS r(k)),
answer AS (SELECT source AS pvname, min(t) AS first_ns, max(t) AS last_ns, count(*) AS num_buckets, nullif(CAST(count(*) % 4 AS INT), 0) AS last_count,
 CASE WHEN count(*) % 3 > 0 THEN 'list' END AS last_type, nullif(count(*) % 5, 0) AS last_period FROM samples WHERE source IN (FROM wanted) GROUP BY 1),
scanned AS (SELECT pvname, min(first_ns) AS first_ns, max(last_ns) AS last_ns, count(*) AS num_buckets, CAST(arg_max(n, bucket_seq) FILTER (WHERE first_ns IS NOT NULL) AS INT) AS last_count,
 arg_max(kind, bucket_seq) FILTER (WHERE first_ns IS NOT NULL) AS last_type, arg_max(period, bucket_seq) FILTER (WHERE kind = 'clock') AS last_period
 FROM buckets WHERE pvname IN (FROM wanted) AND (first_ns IS NULL OR first_ns // 1000000000 < {_NOW + 1}) GROUP BY 1)
SELECT 'OK' AS status, * FROM answer UNION ALL SELECT 'UNIMPLEMENTED', * FROM scanned"""


@query(_INFO)
def query_sources_info(spark, d):
    b = buckets(spark, d)
    n = F.count("*")
    s = samples(spark, d).groupBy(F.col("source").alias("pvname")).agg(
        F.min(F.struct(F.col("seconds").alias("epoch_seconds"), F.col("nanos").alias("nanoseconds"))).alias("first"),
        F.max(F.struct(F.col("seconds").alias("epoch_seconds"), F.col("nanos").alias("nanoseconds"))).alias("last"),
        n.alias("num_buckets"),
        F.pmod(n, F.lit(4)).cast("int").alias("last_count"),
        F.when(F.pmod(n, F.lit(3)) > 0, "list").otherwise("").alias("last_type"),
        F.pmod(n, F.lit(5)).alias("last_period"),
    )
    calls = [bk.sources_info(s, status, b, [*_NAMES, "", "EV:none"], _NOW).withColumn("status", F.lit(status)) for status in ("OK", "UNIMPLEMENTED", "UNAVAILABLE")]
    rows = calls[0].unionByName(calls[1]).unionByName(calls[2])
    return rows.select("status", "pvname", _ns("first").alias("first_ns"), _ns("last").alias("last_ns"), "num_buckets", "last_count", "last_type", "last_period")


@query(f"WITH {METRICS} SELECT name, reader, source, round(sum(value), 2) AS value FROM metrics GROUP BY ALL")
def met_counters(spark, d):
    return metrics.counters(metric_events(spark, d), ["reader", "source"]).withColumn("value", F.round("value", 2))


@query(f"WITH {METRICS} SELECT name, reader, source, arg_max(value, seq) AS value FROM metrics GROUP BY ALL")
def met_gauges(spark, d):
    return metrics.gauges(metric_events(spark, d), ["reader", "source"])


def _histogram(name, bounds, scale):
    def run(spark, d):
        e = table(spark, d, "events").withColumn("v", F.col("value") * scale)
        out = metrics.histogram(e, ["event_type"], "v", bounds)
        return out.withColumn("total_sum", F.round("total_sum", 4))

    les = ", ".join(f"('{b}', {b}::DOUBLE)" for b in bounds)
    SQL[name] = f"""WITH le(le, bound) AS (VALUES {les}, ('+Inf', 'inf'::DOUBLE)), e AS (SELECT event_type, value * {scale}::DOUBLE AS v FROM events)
 SELECT event_type, le, count(*) FILTER (WHERE v <= bound) AS count, round(sum(v), 4) AS total_sum, count(*) AS total_count FROM e, le GROUP BY event_type, le"""
    QUERIES[name] = run


_histogram("met_histogram_ms", metrics.PROCESSING_MS, 10.0)
_histogram("met_histogram_s", metrics.SEND_SECONDS, 0.01)

_SNAP = METRICS + """, lab AS (SELECT *, coalesce(nullif(reader, ''), nullif(source, '')) AS label FROM metrics),
snap AS (SELECT label, coalesce(arg_max(value, seq) FILTER (WHERE name = 'pushes_total'), 0) AS pushes, coalesce(arg_max(value, seq) FILTER (WHERE name = 'payload_bytes_total'), 0) AS bytes,
 coalesce(arg_max(value, seq) FILTER (WHERE name = 'throughput_bytes_per_second'), 0) AS rate FROM lab WHERE label IS NOT NULL GROUP BY label)"""


@query(f"WITH {_SNAP} SELECT * FROM snap")
def met_snapshot(spark, d):
    return metrics.snapshot(metric_events(spark, d))


_POOLS = """pools AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'ingestion' WHEN 1 THEN 'query' END AS pool, ['pool_connections_in_use', 'pool_connections_available'][o_orderkey % 2 + 1] AS name,
 o_custkey % 16 AS value, o_orderkey AS seq FROM orders)"""


@query(f"""WITH {_POOLS}, each AS (SELECT pool, CAST(coalesce(arg_max(value, seq) FILTER (WHERE name = 'pool_connections_in_use'), 0) AS BIGINT) AS in_use,
 CAST(coalesce(arg_max(value, seq) FILTER (WHERE name = 'pool_connections_available'), 0) AS BIGINT) AS available FROM pools WHERE pool IS NOT NULL GROUP BY 1)
SELECT * FROM each UNION ALL SELECT NULL, CAST(sum(in_use) AS BIGINT), CAST(sum(available) AS BIGINT) FROM each""")
def met_pool_snapshot(spark, d):
    o = table(spark, d, "orders")
    kind = F.pmod("o_custkey", F.lit(3))
    name = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "pool_connections_in_use").otherwise("pool_connections_available")
    pool = F.when(kind == 0, "ingestion").when(kind == 1, "query")
    return metrics.pool_snapshot(o.select(name.alias("name"), pool.alias("pool"), F.pmod("o_custkey", F.lit(16)).cast("double").alias("value"), F.col("o_orderkey").alias("seq")))


_SCANS = ("vm_size", "vm_rss", "vm_peak", "rss_anon", "rss_file", "rss_shmem", "num_fds", "num_threads", "priority", "nice")
_READING = ", ".join(f"CASE WHEN (event_id + {k}) % 3 > 0 THEN (event_id * {k + 7}) % 1009 END AS {c}" for k, c in enumerate(_SCANS))


@query(f"""WITH scans AS (SELECT user_id AS pid, event_id AS seq, {_READING} FROM events),
 whole AS (SELECT *, CASE WHEN coalesce(rss_anon, rss_file, rss_shmem) IS NOT NULL THEN coalesce(rss_anon, 0) + coalesce(rss_file, 0) + coalesce(rss_shmem, 0) END AS total_rss FROM scans),
 last AS (SELECT pid, {", ".join(f"CAST(arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS DOUBLE) AS {name}" for c, name in metrics.PROCESS_GAUGES.items())} FROM whole GROUP BY pid)
SELECT pid, name, value FROM (UNPIVOT last ON COLUMNS(* EXCLUDE pid) INTO NAME name VALUE value)""")
def met_process_gauges(spark, d):
    e = table(spark, d, "events")
    scans = e.select(F.col("user_id").alias("pid"), F.col("event_id").alias("seq"), *[F.when(F.pmod(F.col("event_id") + k, F.lit(3)) > 0, F.pmod(F.col("event_id") * (k + 7), F.lit(1009))).alias(c) for k, c in enumerate(_SCANS)])
    return metrics.process_gauges(scans, ["pid"])


_SIZE = "CASE WHEN {c} >= 1048576 THEN printf('%.2f MB', {c} / 1048576.0) WHEN {c} >= 1024 THEN printf('%.2f KB', {c} / 1024.0) ELSE printf('%.0f B', {c}) END"


@query(f"WITH {_SNAP} SELECT label, label || ': ' || printf('%.0f', pushes) || ' pushes, ' || {_SIZE.format(c='bytes')} || ', ' || {_SIZE.format(c='rate')} || '/s' AS line FROM snap")
def met_snapshot_text(spark, d):
    return metrics.report(metrics.snapshot(metric_events(spark, d)))


@query(f"WITH {_SNAP} SELECT round(sum(pushes), 2) AS pushes, round(sum(bytes), 2) AS bytes, round(sum(rate), 2) AS rate FROM snap")
def met_totals(spark, d):
    t = metrics.totals(metrics.snapshot(metric_events(spark, d)))
    return t.select(*[F.round(c, 2).alias(c) for c in t.columns])


@query("""SELECT l_returnflag, arg_max(l_quantity * 100 * 1000.0::DOUBLE / (l_linenumber - 1), (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS bytes_per_second FROM lineitem WHERE l_linenumber > 1 GROUP BY l_returnflag""")
def met_throughput(spark, d):
    li = table(spark, d, "lineitem")
    items = li.select("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), (F.col("l_quantity") * 100).alias("bytes"), (F.col("l_linenumber") - 1).alias("elapsed_ms"))
    return metrics.throughput(items, ["l_returnflag"])


@query("""SELECT o_orderpriority AS reader, sum(n) AS received, sum(CASE WHEN o_orderkey % 9 <> 0 THEN n ELSE 0 END) AS processed, sum(CASE WHEN o_orderkey % 9 <> 0 THEN 0 ELSE n END) AS dropped
 FROM (SELECT *, CAST(1 + o_custkey % 7 AS DOUBLE) AS n FROM orders) GROUP BY 1""")
def met_drop_rate(spark, d):
    o = table(spark, d, "orders").withColumn("value", (1 + F.pmod("o_custkey", F.lit(7))).cast("double"))
    both = o.select(F.col("o_orderpriority").alias("reader"), F.lit("received").alias("name"), "value")
    both = both.unionByName(o.where("o_orderkey % 9 <> 0").select(F.col("o_orderpriority").alias("reader"), F.lit("processed").alias("name"), "value"))
    return metrics.drop_rate(both, ["reader"])


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN value ELSE event_id * 10 + value END AS reading FROM events)
 SELECT user_id, event_id, CASE WHEN lag(reading) OVER w IS NULL OR reading < lag(reading) OVER w THEN reading ELSE reading - lag(reading) OVER w END AS delta
 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def met_process_delta(spark, d):
    e = table(spark, d, "events").withColumn("reading", F.when(F.pmod("event_id", F.lit(50)) == 0, F.col("value")).otherwise(F.col("event_id") * 10 + F.col("value")))
    return metrics.counter_deltas(e, ["user_id"], "event_id", "reading").select("user_id", "event_id", "delta")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events""")
def met_queue_depth(spark, d):
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).cast("long")
    return metrics.queue_depth(table(spark, d, "events"), ["user_id"], "event_id", step).select("user_id", "event_id", "depth")


@query(f"""WITH {METRICS} SELECT name || '{{reader="' || reader || '",source="' || source || '"}} ' || CAST(value AS VARCHAR) AS line FROM metrics WHERE reader IS NOT NULL""")
def met_prometheus_text(spark, d):
    m = metric_events(spark, d).where("reader is not null")
    labels = F.create_map(F.lit("reader"), F.col("reader"), F.lit("source"), F.col("source"))
    return metrics.exposition(m.select("name", labels.alias("labels"), "value"))


@query("""WITH h AS (SELECT event_type AS source, 'send_time_sum' AS name, round(sum(value), 2) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'send_time_count', count(*) FROM events GROUP BY 1
 UNION ALL SELECT event_type, 'pushes_total', count(*) FROM events GROUP BY 1)
 SELECT regexp_replace(name, '_(bucket|sum|count)$', '') AS base, count(*) AS n, '[' || string_agg('{"histogram":"' || f || '","source":"' || source || '","value":' || value || '}', ',' ORDER BY f, source) || ']' AS members
 FROM (SELECT *, regexp_extract(name, '_(bucket|sum|count)$', 1) AS f FROM h) GROUP BY 1""")
def met_json_groups(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.round(F.sum("value"), 2).alias("s"), F.count("*").cast("double").alias("n"))
    rows = e.select("source", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).alias("value")) for k, v in (("send_time_sum", "s"), ("send_time_count", "n"), ("pushes_total", "n"))])))
    return metrics.json_groups(rows)


def _frames(spark, d):
    """A frame for each order: timestamps are its lines' numbers, columns its flags; some are without the one or the other."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ts"), F.collect_set("l_returnflag").alias("cols"))
    k = F.col("l_orderkey")
    return li.select(
        F.col("l_orderkey").alias("frame"),
        F.floor(k / 4).alias("batch_id"),
        F.when(F.pmod(F.floor(k / 4), F.lit(13)) == 0, "").otherwise(F.concat(F.lit("root"), F.pmod(k, F.lit(17)).cast("string"))).alias("root_source"),
        F.pmod(k, F.lit(3)).alias("stream_start"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.slice("ts", 1, 0)).otherwise(F.col("ts")).alias("ts_list"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.slice("cols", 1, 0)).otherwise(F.col("cols")).alias("columns"),
    )


_FRAMES = """frames AS (SELECT l_orderkey AS frame, l_orderkey // 4 AS batch_id, CASE WHEN l_orderkey // 4 % 13 = 0 THEN '' ELSE 'root' || (l_orderkey % 17) END AS root_source, l_orderkey % 3 AS stream_start,
 CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) END AS n_ts, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE count(DISTINCT l_returnflag) END AS n_cols FROM lineitem GROUP BY l_orderkey)"""


@query(f"WITH {_FRAMES} SELECT root_source, count(*) AS failures FROM frames WHERE n_ts = 0 AND root_source <> '' GROUP BY 1")
def flt_missing_timestamp(spark, d):
    return delivery.error_counts(delivery.check_frames(_frames(spark, d))).where("error = 'no timestamps'").select("root_source", "failures")


@query(f"WITH {_FRAMES} SELECT frame FROM frames WHERE n_ts > 0 AND n_cols > 0")
def flt_no_columns(spark, d):
    return delivery.check_frames(_frames(spark, d)).where("error is null").select("frame")


@query(f"""WITH {_FRAMES} SELECT batch_id, count(*) AS n_frames, count(*) FILTER (WHERE n_ts > 0 AND root_source <> '') AS n_enqueued,
 count(*) FILTER (WHERE n_ts > 0 AND root_source <> '') > 0 AS accepted FROM frames GROUP BY 1""")
def flt_batch_accept(spark, d):
    return delivery.accept_batches(_frames(spark, d))


@query(f"""WITH {_FRAMES}, queued AS (SELECT *, row_number() OVER (PARTITION BY stream_start ORDER BY frame) - 1 AS n FROM frames WHERE n_ts > 0 AND root_source <> '')
 SELECT 'provider-1' AS provider_id, concat_ws('_', 'pv_stream', stream_start, root_source, n) AS request_id, root_source, CAST(n_ts AS INT) AS events FROM queued WHERE n_cols > 0""")
def snk_requests(spark, d):
    return delivery.requests(_frames(spark, d), "provider-1", ["frame"])


@query(f"WITH {_FRAMES} SELECT frame, CAST((row_number() OVER (ORDER BY batch_id, frame) - 1) % 3 AS INT) AS worker FROM frames WHERE n_ts > 0 AND root_source <> ''")
def snk_round_robin(spark, d):
    return delivery.round_robin(_frames(spark, d).drop("columns"), ["batch_id", "frame"], 3).select("frame", "worker")


@query("""SELECT o_orderkey, CASE WHEN acked < 0 THEN 'INVALID' WHEN acked < sent THEN 'INCOMPLETE' WHEN acked > sent THEN 'EXTRA' ELSE 'OK' END AS status
 FROM (SELECT o_orderkey, o_custkey % 5 AS sent, o_orderkey % 7 - 1 AS acked FROM orders)""")
def snk_ack_status(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(5)).alias("sent"), (F.pmod("o_orderkey", F.lit(7)) - 1).alias("acked"))
    return delivery.ack_status(o).select("o_orderkey", "status")


@query(f"WITH {_FRAMES} SELECT frame, CAST(n_ts AS INT) AS events, CAST(length(root_source) + 8 * n_ts * n_cols + 12 * n_ts AS BIGINT) AS payload FROM frames")
def snk_accounting(spark, d):
    f = _frames(spark, d)
    n, c = F.size("ts_list"), F.size("columns")
    return f.select("frame", n.alias("events"), delivery.payload_bytes(F.length("root_source"), n * c, n).alias("payload"))
