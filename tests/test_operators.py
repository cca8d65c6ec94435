"""Conversions, tables, buckets, metrics and delivery on small fixtures, edge cases first."""

import json
from collections import Counter
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from kelpline.functions import text
from kelpline.operators import buckets, convert, delivery, metrics, numbering, tables, windows
from kelpline.streaming import replay


def one(df):
    return df.collect()[0]


def test_unsigned_boundaries(spark):
    values = [255, 65535, 2**31 - 1, 2**31, 2**32 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "v decimal(20,0)")
    got = [r.w for r in df.select(convert.wrap_unsigned(F.col("v"), 64).alias("w")).collect()]
    assert got == [255, 65535, 2**31 - 1, 2**31, 2**32 - 1, -(2**63), -1]
    assert [r.w for r in df.select(convert.wrap_unsigned(F.col("v"), 32).alias("w")).collect()][2:5] == [2**31 - 1, -(2**31), -1]


def test_table_cells_are_cut_not_padded(spark):
    df = spark.sql("select 1 as root, array(1L, 2L, 3L) as s, array(0L, 5L) as n, array(1d, 2d, 3d) as long, array(1d) as short, cast(array() as array<double>) as none")
    got = tables.unpivot(df, ["root"], ["long", "short", "none"], "s", "n").orderBy("source", "pos").collect()
    assert [(r.source, r.pos, r.seconds, r.nanos) for r in got] == [("long", 0, 1, 0), ("long", 1, 2, 5), ("short", 0, 1, 0)]


def test_empty_times_fail_the_update(spark):
    df = spark.sql("select 1 as root, cast(array() as array<bigint>) as s, array(0L) as n, array(1d) as v")
    assert tables.unpivot(df, ["root"], ["v"], "s", "n").isEmpty()


def test_column_batches_of_zero(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "root int, source string, col_pos int")
    assert {r.batch for r in tables.column_batches(df, ["root"], 0).collect()} == {0}


def test_clock_carry(spark):
    end = buckets.clock_end(F.lit(5), F.lit(999_999_999), F.lit(2), F.lit(2))
    assert one(spark.range(1).select(end.alias("e"))).e == (6, 1)
    same = buckets.clock_end(F.lit(5), F.lit(7), F.lit(10), F.lit(1))
    assert one(spark.range(1).select(same.alias("e"))).e == (5, 7)


def test_empty_request_and_empty_name(spark):
    df = spark.sql("select 'a' as pvname, 1L as bucket_seq, array(named_struct('epoch_seconds', 100L, 'nanoseconds', 0)) as ts_list, cast(null as struct<epoch_seconds: bigint, nanoseconds: int, period_ns: bigint, count: int>) as clock, array(1d) as values")
    assert buckets.sources_data(df, ["a"], 100).count() == 1
    assert buckets.sources_data(df, ["a", ""], 100).count() == 0
    assert buckets.sources_data(df, [], 100).count() == 0


def test_exposition_escapes(spark):
    df = spark.sql("""select 'm' as name, map('l', 'a"b\\\\c\\n}') as labels, 1.5d as value""")
    assert one(metrics.exposition(df)).line == 'm{l="a\\"b\\\\c\\n}"} 1.5'


def test_json_numbers_of_any_size(spark):
    values = [0.0, 2.5e-300, 1e-05, 1.5e-05, 0.0001, 0.00098765, 0.001, 9999999.9, 1e7, -59907727.8, 59909850.0, 123456789012345.67, 9999999999999998.0, 1e16, -1.25e17, 1.5e300]
    df = spark.createDataFrame([("m_sum", f"{k:02}", v) for k, v in enumerate(values)], "name string, source string, value double")
    members = ",".join(f'{{"histogram":"sum","source":"{k:02}","value":{v!r}}}' for k, v in enumerate(values))
    assert tuple(one(metrics.json_groups(df))) == ("m", len(values), f"[{members}]")
    odd = spark.createDataFrame([("m", '"value":1.0E7}', None), ("m", "a", float("nan")), ("m", "b", float("inf")), ("m", None, 2e7)], df.schema)
    want = [{"histogram": "", "source": '"value":1.0E7}'}, {"histogram": "", "source": "a", "value": "NaN"}, {"histogram": "", "source": "b", "value": "Infinity"}, {"histogram": "", "value": 2e7}]
    key = lambda m: m.get("source", "")
    assert sorted(json.loads(one(metrics.json_groups(odd)).members), key=key) == sorted(want, key=key)
    assert one(metrics.json_groups(df.withColumn("value", F.lit(20_000_000)).limit(1))).members == '[{"histogram":"sum","source":"00","value":20000000}]'


def test_percent_encoding(spark):
    assert one(spark.range(1).select(text.percent_encode(F.lit("a b*~+/:-_.é")).alias("e"))).e == "a%20b%2A~%2B%2F%3A-_.%C3%A9"


def test_inference_takes_whole_tokens(spark):
    df = spark.createDataFrame([(t,) for t in ["True", "yes", "12", "1.5", "1x", "", "t", "99999999999999999999"]], "t string")
    kind, *_ = text.infer_scalar("t")
    assert [r.k for r in df.select(kind.alias("k")).collect()] == ["bool", "string", "int64", "double", "string", "string", "string", "double"]


def test_marks_last_over_batches_and_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    make = lambda rows, n: spark.createDataFrame(rows, "source string, seq long, seconds long, nanos int").coalesce(1).write.parquet(f"{folder}/{n}")
    make([("p", 1, 10, 0), ("p", 2, 12, 0)], "a")
    work = f"file://{tmp_path}/work"
    stream = lambda: replay.newer_only(replay.file_stream(spark, f"{folder}/*"), "source", "seconds", "nanos", "seq")
    out = replay.run_available(stream(), work)
    make([("p", 3, 11, 0), ("p", 4, 12, 0), ("p", 5, 12, 1)], "b")
    replay.run_available(stream(), work)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [1, 2, 5]


FRAMES = "batch_id int, frame int, root_source string, stream_start long, ts_list array<int>, columns array<string>"


def test_a_batch_is_accepted_for_frames_with_times(spark):
    rows = [(1, 1, "r", 0, [1], []), (2, 2, "r", 0, [], ["c"]), (3, 3, "", 0, [1], ["c"]), (4, 4, None, 0, [1], ["c"]), (5, 5, "r", 0, None, ["c"]), (5, 6, "r", 0, [1], ["c"])]
    df = spark.createDataFrame(rows, FRAMES)
    got = {r.batch_id: (r.n_frames, r.n_enqueued, r.accepted) for r in delivery.accept_batches(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 0, False), 3: (1, 0, False), 4: (1, 0, False), 5: (2, 1, True)}
    assert {(r.root_source, r.error): r.failures for r in delivery.error_counts(delivery.check_frames(df)).collect()} == {("r", "no timestamps"): 2, ("r", "no columns"): 1}


def test_requests_are_numbered_by_stream(spark):
    rows = [(1, 1, "a", 7, [1], ["c"]), (1, 2, "b", 7, [1], ["c"]), (1, 3, "", 7, [1], ["c"]), (1, 4, "a", 7, [1], []), (1, 5, "a", 7, [], ["c"]), (1, 6, "b", 7, [1, 2], ["c"]), (1, 7, "a", 8, [1], ["c"])]
    got = [(r.request_id, r.root_source, r.events) for r in delivery.requests(spark.createDataFrame(rows, FRAMES), "p", ["frame"]).orderBy("request_id").collect()]
    assert got == [("pv_stream_7_a_0", "a", 1), ("pv_stream_7_b_1", "b", 1), ("pv_stream_7_b_3", "b", 2), ("pv_stream_8_a_0", "a", 1)]


def test_numbers_and_running_values_over_slices(spark):
    rows = [(k * 7919 % 1000, k % 3 or None, k) for k in range(1000)] + [(None, 1, 1000)]
    df = spark.createDataFrame(rows, "t int, k int, v long").withColumn("n", F.lit(1))
    got = {r.v: r.i for r in numbering.numbered(df, ["t", "v"], "i").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert got == {r[2]: i for i, r in enumerate(order)}
    total, most, want = Counter(), {}, {}
    for t, k, v in order:
        total[k] += v
        want[v] = (total[k], most.get(k))
        most[k] = max(v, most.get(k, 0))
    sums = numbering.running(df, ["k"], ["t", "v"], F.col("v"), F.sum, lambda a, b: a + b, "s")
    both = numbering.running(sums, ["k"], ["t", "v"], F.col("v"), F.max, F.greatest, "m", itself=False)
    assert {r.v: (r.s, r.m) for r in both.collect()} == want
    assert numbering.numbered(df.limit(0), ["t"], "i").count() == 0


def test_rotation_by_runs_is_rotation_by_items():
    def plain(fold, t, n):
        out, opened, start, held, stream = [], False, 0, 0, -1
        for at, size in zip(t, n):
            if not opened or at - start >= fold.age or held > 0 and held + size > fold.size:
                opened, start, held, stream = True, at, 0, stream + 1
            held += size
            out.append(stream)
            opened = not (at - start >= fold.age or held >= fold.size)
        return out

    rng = np.random.default_rng(1)
    for trial in range(500):
        n = int(rng.integers(0, 60))
        fold = windows.RotationFold(int(rng.integers(0, 30)), int(rng.integers(1, 60)))
        t, b = np.cumsum(rng.integers(-2 if trial % 3 else 0, 6, n)), rng.integers(0, 25, n)
        cut = int(rng.integers(0, n + 1))
        assert [*fold.run(t[:cut], b[:cut]), *fold.run(t[cut:], b[cut:])] == plain(fold, t.tolist(), b.tolist())


def test_pools_are_summed_not_hidden(spark):
    rows = [("pool_connections_in_use", "ingestion", 2.0, 1), ("pool_connections_in_use", "query", 1.0, 2), ("pool_connections_in_use", "ingestion", 3.0, 5), ("pool_connections_available", "query", 4.0, 3), ("other", "query", 9.0, 9), ("pool_connections_in_use", None, 9.0, 9)]
    df = spark.createDataFrame(rows, "name string, pool string, value double, seq long")
    assert {(r.pool, r.in_use, r.available) for r in metrics.pool_snapshot(df).collect()} == {("ingestion", 3, 0), ("query", 1, 4), (None, 4, 4)}
    assert [tuple(r) for r in metrics.pool_snapshot(df.limit(0)).collect()] == [(None, 0, 0)]


def test_gauges_keep_what_a_scan_lacks(spark):
    none = "cast(null as long)"
    df = spark.sql(f"select 1 as pid, 1L as seq, 10L as vm_size, 5L as vm_rss, {none} as vm_peak, 1L as rss_anon, {none} as rss_file, 2L as rss_shmem, 7L as num_fds, 2L as num_threads, 20L as priority, 0L as nice union all select 1, 2L, 11L, {none}, {none}, {none}, {none}, {none}, 8L, {none}, 20L, 0L")
    got = {r.name: r.value for r in metrics.process_gauges(df, ["pid"]).collect()}
    assert got == {"process_memory_virtual_bytes": 11, "process_memory_rss_bytes": 5, "process_memory_rss_anon_bytes": 1, "process_memory_rss_shmem_bytes": 2, "process_memory_rss_total_bytes": 3, "process_fds_open": 8, "process_threads": 2, "process_priority": 20, "process_nice": 0}


def test_sources_info_by_the_call_s_end(spark):
    df = spark.sql("select 'a' as pvname, 1L as bucket_seq, array(named_struct('epoch_seconds', 100L, 'nanoseconds', 0)) as ts_list, cast(null as struct<epoch_seconds: bigint, nanoseconds: int, period_ns: bigint, count: int>) as clock, array(1d) as values")
    answer = spark.sql("select 'a' as pvname, named_struct('epoch_seconds', 1L, 'nanoseconds', 0) as first, named_struct('epoch_seconds', 2L, 'nanoseconds', 0) as last, 9L as num_buckets, 0 as last_count, '' as last_type, 0L as last_period")
    ask = lambda status, names=("a", ""), now=100, message="": [tuple(r) for r in buckets.sources_info(answer, status, df, list(names), now, message).select("pvname", "num_buckets", "last_count", "last_type").collect()]
    assert ask("OK") == [("a", 9, None, None)]
    assert ask("UNIMPLEMENTED") == [("a", 1, 1, "list")] == ask("UNKNOWN", message="x: Method not found")
    assert ask("UNIMPLEMENTED", now=98) == [] == ask("UNAVAILABLE") == ask("OK", ("", "b")) == ask("UNIMPLEMENTED", ())



def test_values_of_no_kind_become_text(spark):
    df = spark.sql("select named_struct('a', 1, 'b', array(1.5d, null)) as v union all select null")
    assert sorted(r.t for r in df.select(convert.dump_value(F.col("v")).alias("t")).collect()) == ['{"value":{"a":1,"b":[1.5,null]}}', "{}"]
