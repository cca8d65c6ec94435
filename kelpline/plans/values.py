"""Queries of conversions, tables and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.functions import text, time
from kelpline.operators import convert, tables
from kelpline.plans.inputs import UPDATES, samples, table, updates

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_partkey, l_linenumber, kind, CASE kind WHEN 'bool' THEN CAST(l_quantity > 25 AS VARCHAR) WHEN 'int16' THEN CAST(CAST(l_quantity AS INT) AS VARCHAR)
 WHEN 'int64' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE NULL END AS exact, CASE WHEN kind = 'float64' THEN l_extendedprice END AS number,
 CASE WHEN kind = 'string' THEN l_returnflag END AS word
 FROM (SELECT *, ['bool', 'int16', 'int64', 'float64', 'string'][l_linenumber % 5 + 1] AS kind FROM lineitem)""")
def cnv_scalar_types(spark, d):
    li = table(spark, d, "lineitem").withColumn("kind", F.element_at(F.array(*map(F.lit, ("bool", "int16", "int64", "float64", "string"))), (F.pmod("l_linenumber", F.lit(5)) + 1)))
    q = F.col("l_quantity")
    raw = F.when(F.col("kind") == "bool", (q > 25).cast("string")).when(F.col("kind") == "string", F.col("l_returnflag")).when(F.col("kind") == "float64", F.col("l_extendedprice").cast("string")).otherwise(q.cast("long").cast("string"))
    rows = convert.stored_values(li.withColumn("raw", raw), "kind", "raw")
    exact = F.coalesce(F.col("v_bool").cast("string"), F.col("v_int").cast("string"), F.col("v_long").cast("string"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "kind", exact.alias("exact"), F.col("v_double").alias("number"), F.col("v_string").alias("word"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CAST((u32 + 2147483648) % 4294967296 - 2147483648 AS INT) AS i32,
 CAST((u64 + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS i64
 FROM (SELECT *, (l_partkey * 2654435761::BIGINT) % 4294967296 AS u32, (l_orderkey::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS u64 FROM lineitem)""")
def cnv_unsigned_wrap(spark, d):
    li = table(spark, d, "lineitem")
    u32 = F.pmod(F.col("l_partkey") * 2654435761, F.lit(4294967296))
    u64 = F.expr("pmod(cast(l_orderkey as decimal(18,0)) * 11400714819323198485BD, 18446744073709551616BD)")
    return li.select("l_orderkey", "l_partkey", "l_linenumber", convert.wrap_unsigned(u32, 32).alias("i32"), convert.wrap_unsigned(u64, 64).alias("i64"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dimensions, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def cnv_array_column(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.size("embedding").alias("dimensions"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT p_partkey, CAST(pos AS INT) AS pos, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)")
def cnv_string_array(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("""SELECT event_id, user_id AS "value.user", event_type AS "value.kind.name", CAST(json_extract(props, '$.k') AS BIGINT) AS "value.kind.k" FROM events""")
def cnv_struct_flatten(spark, d):
    e = table(spark, d, "events")
    k = F.from_json("props", "k bigint").getField("k")
    nested = e.select("event_id", F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("name"), k.alias("k")).alias("kind")).alias("value"))
    return convert.flatten_structs(nested)


@query("""SELECT root, CAST(pos AS INT) AS pos, name, value FROM (WITH """ + UPDATES + """ SELECT root, pos, unnest(['cell.line', 'cell.qty']) AS name,
 unnest([CAST(ns AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)]) AS value FROM li)""")
def cnv_struct_array(spark, d):
    u = updates(spark, d).select("root", F.transform(F.arrays_zip(F.col("nanos"), F.col("qty")), lambda x: F.struct(x.nanos.alias("line"), x.qty.cast("long").alias("qty"))).alias("cell"))
    return convert.struct_array_rows(u, ["root"], "cell")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type ELSE NULL END AS value FROM events")
def cnv_union(spark, d):
    e = table(spark, d, "events")
    k = F.pmod("event_id", F.lit(3))
    rows = e.select("event_id", F.when(k == 0, F.col("user_id")).alias("as_long"), F.when(k == 1, F.col("event_type")).alias("as_string"))
    return rows.select("event_id", convert.unwrap_union(["as_long", "as_string"]).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'null' ELSE event_type END AS value FROM events")
def cnv_null_literal(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", convert.null_literal(F.when(F.pmod("event_id", F.lit(4)) != 0, F.col("event_type"))).alias("value"))


@query("""SELECT o_orderkey, CAST(epoch_us(make_timestamp(CAST(1960 + o_orderkey % 80 AS BIGINT), 1, 1, 0, 0, 0)) // 1000000 + o_custkey AS BIGINT) AS epoch FROM orders WHERE o_orderkey % 80 >= 10
 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 80 < 10""")
def cnv_epoch_from_year(spark, d):
    o = table(spark, d, "orders").withColumn("year", (F.lit(1960) + F.pmod("o_orderkey", F.lit(80))).cast("int"))
    return o.select("o_orderkey", time.epoch_from_year("year", "o_custkey").alias("epoch"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events")
def fn_iso8601_millis(spark, d):
    return table(spark, d, "events").select("event_id", time.iso8601_millis("ts").alias("iso"))


def _updates_with_gaps(spark, d):
    s = samples(spark, d)
    k = F.col("seq")
    return s.select(
        "seq",
        F.when(F.pmod(k, F.lit(11)) != 0, F.col("value")).alias("value"),
        F.when(F.pmod(k, F.lit(7)) != 0, F.lit(0)).alias("alarm"),
        F.when(F.pmod(k, F.lit(5)) != 0, F.col("seconds")).alias("seconds"),
        F.col("nanos"),
        (F.pmod(k, F.lit(13)) == 0).alias("compound"),
    )


@query("""SELECT event_id AS seq, event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 13 <> 0 AS accepted,
 CASE WHEN event_id % 11 = 0 THEN 'no value' WHEN event_id % 7 = 0 THEN 'no alarm' WHEN event_id % 5 = 0 THEN 'no timestamp' WHEN event_id % 13 = 0 THEN 'compound value' END AS reason FROM events""")
def mode_default_strict(spark, d):
    return convert.default_mode(_updates_with_gaps(spark, d), strict=True).select("seq", "accepted", "reason")


@query("""SELECT event_id AS seq, event_id % 11 <> 0 AS accepted, CASE WHEN event_id % 5 = 0 THEN 1706745600 ELSE epoch_us(ts) // 1000000 END AS seconds,
 CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) % 1000000 * 1000 END AS INT) AS nanos FROM events""")
def mode_default_lenient(spark, d):
    return convert.default_mode(_updates_with_gaps(spark, d), strict=False, now=F.lit(1706745600)).select("seq", "accepted", "seconds", "nanos")


@query("""WITH """ + UPDATES + """ SELECT root, 'qty' AS "column", CAST(pos AS INT) AS pos, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM li
 UNION ALL SELECT root, 'lines', 0, '[' || string_agg(ns, ',' ORDER BY pos) || ']' FROM li GROUP BY root""")
def query_flatten_values(spark, d):
    u = updates(spark, d).select("root", F.col("qty").cast("array<bigint>").alias("qty"), F.col("nanos").alias("lines"))
    return convert.flatten_values(u, ["root"], ["qty"], ["lines"])


@query("""SELECT source, seq, previous_seq, elapsed FROM (SELECT 'EV:' || user_id AS source, event_id AS seq, lag(event_id) OVER w AS previous_seq,
 (epoch_us(ts) - lag(epoch_us(ts)) OVER w) * 1000 AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE previous_seq IS NOT NULL""")
def fn_elapsed_ns(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy("seq")
    s = samples(spark, d).select("source", "seq", "seconds", "nanos", F.lag("seq").over(w).alias("previous_seq"), F.lag("seconds").over(w).alias("s0"), F.lag("nanos").over(w).alias("n0"))
    return s.where("previous_seq is not null").select("source", "seq", "previous_seq", time.elapsed_ns("s0", "n0", "seconds", "nanos").alias("elapsed"))


@query("""SELECT c_custkey, replace(replace(replace(replace(replace(s, '%', '%25'), ' ', '%20'), ':', '%3A'), '#', '%23'), '*', '%2A') AS encoded
 FROM (SELECT c_custkey, c_mktsegment || ' ~' || c_name || ':*-_.' AS s FROM customer)""")
def fn_percent_encode(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.percent_encode(F.concat("c_mktsegment", F.lit(" ~"), "c_name", F.lit(":*-_."))).alias("encoded"))


_HOST = "element_at(array('archiver', 'archiver/', 'https://a.b//', 'http://x:8080'), cast(pmod(c_custkey, 4) + 1 as int))"
_HOST_SQL = "['http://archiver', 'http://archiver', 'https://a.b', 'http://x:8080'][c_custkey % 4 + 1]"


@query(f"SELECT c_custkey, {_HOST_SQL} AS base FROM customer")
def fn_url_base(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.url_base(F.expr(_HOST)).alias("base"))


@query(f"""SELECT c_custkey, {_HOST_SQL} || '/retrieval/data/getData.raw?pv=' || replace(c_name, '#', '%23') || '&from=2024-01-01T00%3A00%3A00.000Z'
 || CASE WHEN c_custkey % 3 <> 0 THEN '&to=2024-01-02T00%3A00%3A00.000Z' ELSE '' END AS url FROM customer""")
def fn_archiver_url(spark, d):
    end = F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.lit("2024-01-02T00:00:00.000Z"))
    return table(spark, d, "customer").select("c_custkey", text.archiver_url(F.expr(_HOST), "c_name", F.lit("2024-01-01T00:00:00.000Z"), end).alias("url"))


@query("SELECT o_orderkey, y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) AS leap FROM (SELECT o_orderkey, 1600 + o_orderkey % 900 AS y FROM orders)")
def fn_leap_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", time.is_leap_year(F.lit(1600) + F.pmod("o_orderkey", F.lit(900))).alias("leap"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1099511627776 THEN printf('%.2f TB', b / 1099511627776.0) WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824.0)
 WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE printf('%.0f B', b) END AS size
 FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * [1, 900, 700000, 600000000, 500000000000][o_orderkey % 5 + 1] + 0.25 * (o_orderkey % 5) AS b FROM orders)""")
def fn_format_bytes(spark, d):
    b = F.expr("cast(o_custkey as double) * element_at(array(1L, 900L, 700000L, 600000000L, 500000000000L), cast(pmod(o_orderkey, 5) + 1 as int)) + cast(0.25 as double) * pmod(o_orderkey, 5)")
    return table(spark, d, "orders").select("o_orderkey", text.format_bytes(b).alias("size"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS a FROM lineitem GROUP BY 1)
 SELECT l_orderkey, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ', +' || (len(a) - 3) || ' more' ELSE '' END AS preview FROM s""")
def fn_preview_list(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")).alias("a"))
    return s.select("l_orderkey", text.preview_list("a").alias("preview"))


_TOKEN = """CASE event_id % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN CAST(user_id AS {s}) WHEN 3 THEN '-' || CAST(user_id AS {s}) WHEN 4 THEN '1.5e3'
 WHEN 5 THEN 'yes' WHEN 6 THEN CAST(user_id AS {s}) || 'x' ELSE '0.25' END"""


@query(f"""SELECT event_id, CASE WHEN lower(t) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN 'int64'
 WHEN regexp_full_match(t, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'double' ELSE 'string' END AS kind,
 CASE WHEN lower(t) IN ('true', 'false') THEN lower(t) = 'true' END AS as_bool, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(t AS BIGINT) END AS as_long,
 CASE WHEN t IN ('1.5e3', '0.25') THEN CAST(t AS DOUBLE) END AS as_double FROM (SELECT event_id, {_TOKEN.format(s='VARCHAR')} AS t FROM events)""")
def fn_infer_scalar(spark, d):
    e = table(spark, d, "events").withColumn("t", F.expr(_TOKEN.format(s="STRING")))
    kind, b, n, x = text.infer_scalar("t")
    return e.select("event_id", kind.alias("kind"), b.alias("as_bool"), n.alias("as_long"), x.alias("as_double"))


@query("SELECT o_orderkey, concat_ws('_', 'pv_stream', o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1) AS request_id FROM orders")
def fn_request_id(spark, d):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select("o_orderkey", text.request_id("o_custkey", "o_orderpriority", n).alias("request_id"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'ca' ELSE 'pva' END AS provider, s_name AS pv FROM supplier")
def src_provider_route(spark, d):
    s = table(spark, d, "supplier").withColumn("full", F.concat(F.expr("element_at(array('pva://', 'ca://', ''), cast(pmod(s_suppkey, 3) + 1 as int))"), F.col("s_name")))
    p, n = text.provider("full")
    return s.select("s_suppkey", p.alias("provider"), n.alias("pv"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'pushes_total' ELSE 'payload_bytes_total' END AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS reader,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS source, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS value FROM orders""")
def met_text_parse(spark, d):
    line = F.expr("""concat(case when pmod(o_orderkey, 2) = 0 then 'pushes_total' else 'payload_bytes_total' end, case when pmod(o_orderkey, 3) <> 0 then concat('{reader="', o_orderpriority, '"} ')
 else concat('{source="', o_orderstatus, '"} ') end, case when pmod(o_orderkey, 7) = 0 then 'bad' else cast(o_custkey as string) end)""")
    n, r, s, v = text.metric_line("line")
    return table(spark, d, "orders").withColumn("line", line).select("o_orderkey", n.alias("name"), r.alias("reader"), s.alias("source"), v.alias("value"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'row-table' ELSE 'default' END AS mode FROM supplier""")
def cfg_mode_lookup(spark, d):
    s = table(spark, d, "supplier")
    options = s.where(F.pmod("s_suppkey", F.lit(4)) == 0).select("s_suppkey", F.lit("row-table").alias("option"))
    return s.join(options, "s_suppkey", "left").select("s_suppkey", F.coalesce("option", F.lit("default")).alias("mode"))


@query("SELECT DISTINCT 'EV:' || user_id AS source FROM events")
def cfg_distinct_sources(spark, d):
    return samples(spark, d).select("source").distinct()


_UNPIVOT = """SELECT root, source, CAST(col_pos AS INT) AS col_pos, CAST(pos AS INT) AS pos, s AS seconds, CAST(ns AS INT) AS nanos, value FROM (
 SELECT root, 'qty' AS source, 0 AS col_pos, pos, s, ns, l_quantity AS value FROM li UNION ALL SELECT root, 'price', 1, pos, s, ns, l_extendedprice FROM li
 UNION ALL SELECT root, 'disc', 2, pos, s, ns, l_discount FROM li WHERE pos < n - 1 {more})"""


@query("WITH " + UPDATES + _UNPIVOT.format(more=""))
def bsas_unpivot(spark, d):
    return tables.unpivot(updates(spark, d), ["root"], ["qty", "price", "disc"], "seconds", "nanos")


@query("WITH " + UPDATES + _UNPIVOT.format(more="UNION ALL SELECT root, 'seconds', 3, pos, s, ns, CAST(s AS DOUBLE) FROM li UNION ALL SELECT root, 'nanos', 4, pos, s, ns, CAST(ns AS DOUBLE) FROM li"))
def bsas_unpivot_base(spark, d):
    return tables.unpivot(updates(spark, d), ["root"], ["qty", "price", "disc"], "seconds", "nanos", with_times=True)


@query("""WITH """ + UPDATES + """ SELECT root, CASE WHEN root % 5 = 3 THEN NULL ELSE CAST(sum(s + CASE WHEN root % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) END AS sum_seconds FROM li GROUP BY root""")
def bsas_ts_resolution(spark, d):
    u = updates(spark, d)
    k = F.pmod("root", F.lit(5))
    later = F.transform("seconds", lambda x: x + 1)
    top_s, top_n = F.when(k == 0, later).when(k == 1, later), F.when(k == 0, F.col("nanos"))  # at 1 only one of the two is at the top level
    inner_s, inner_n = F.when(k != 3, F.col("seconds")), F.col("nanos")
    s, _ = tables.resolve_times(top_s, top_n, inner_s, inner_n)
    return u.select("root", F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_seconds"))


@query("WITH " + UPDATES + " SELECT root, CASE WHEN any_value(n) > 1 THEN CAST(any_value(n) - 1 AS INT) END AS n_rows FROM li GROUP BY root")
def bsas_row_count(spark, d):
    u = updates(spark, d).withColumn("short", F.slice("nanos", 1, F.greatest(F.size("nanos") - 1, F.lit(0))))
    return u.select("root", tables.row_count(F.col("seconds"), F.col("short")).alias("n_rows"))


@query("WITH " + UPDATES + " SELECT root, round(sum(CASE WHEN pos % 2 = 0 THEN l_quantity ELSE l_discount END), 6) AS total FROM li GROUP BY root")
def bsas_compound_cells(spark, d):
    li = table(spark, d, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    per = li.groupBy(F.col("l_orderkey").alias("root")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    cells = F.transform("r", lambda x, i: F.struct(F.when(i % 2 == 0, x.l_quantity).alias("value"), x.l_discount.alias("raw")))
    return per.select("root", F.round(F.aggregate(tables.cell_value(cells), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH """ + UPDATES + """, c AS (SELECT root, unnest(['qty', 'price', 'disc']) AS source, unnest([0, 1, 2]) AS col_pos, any_value(n) AS n FROM li GROUP BY root)
 SELECT root, source, CAST(col_pos AS INT) AS col_pos, (row_number() OVER (PARTITION BY root ORDER BY col_pos) - 1) // 2 AS batch FROM c WHERE source <> 'disc' OR n > 1""")
def bsas_column_batches(spark, d):
    rows = tables.unpivot(updates(spark, d), ["root"], ["qty", "price", "disc"], "seconds", "nanos")
    return tables.column_batches(rows.where("pos = 0").select("root", "source", "col_pos"), ["root"], 2)


@query("""SELECT user_id, hour, base, Val, CNT, round(RMS, 6) AS RMS, round(AVG, 6) AS AVG, MIN, MAX FROM (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, unnest(['BEAM', 'HALF']) AS base,
 unnest([arg_max(value, event_id), arg_max(value, event_id) / 2]) AS Val, unnest([count(*)::DOUBLE, count(*)::DOUBLE]) AS CNT, unnest([sqrt(avg(value * value)), NULL]) AS RMS,
 unnest([avg(value), avg(value) / 2]) AS AVG, unnest([min(value), NULL]) AS MIN, unnest([max(value), NULL]) AS MAX FROM events GROUP BY user_id, hour)""")
def bsas_gen2_stats(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.floor(time.seconds_of("ts") / 3600))
    last = F.max_by("value", "event_id")
    wide = e.groupBy("user_id", "hour").agg(
        last.alias("BEAM.Val"), F.count("*").alias("BEAM.CNT"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("BEAM.RMS"), F.avg("value").alias("BEAM.AVG"),
        F.min("value").alias("BEAM.MIN"), F.max("value").alias("BEAM.MAX"), (last / 2).alias("HALF.Val"), F.count("*").alias("HALF.CNT"), (F.avg("value") / 2).alias("HALF.AVG"),
    )
    rows = tables.statistics(wide, ["user_id", "hour"], wide.columns)
    return rows.withColumn("RMS", F.round("RMS", 6)).withColumn("AVG", F.round("AVG", 6))
