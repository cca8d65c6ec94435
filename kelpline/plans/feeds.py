"""Queries of sources, framing, configuration and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from kelpline.functions.time import nanos_of, seconds_of
from kelpline.plans.inputs import SAMPLES, samples, table
from kelpline.sources import config, pbhttp
from kelpline.streaming import replay

QUERIES, SQL = {}, {}
YEAR = 1704067200  # 2024


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_OUT = pa.schema([("source", pa.string()), ("seq", pa.int64()), ("pos", pa.int32()), ("payload", pa.string()), ("seconds", pa.int64()), ("nanos", pa.int32()), ("v_int", pa.int64()), ("v_number", pa.float64()), ("v_text", pa.string())])
_SCALARS = ("SCALAR_DOUBLE", "SCALAR_INT", "SCALAR_STRING", "SCALAR_SHORT")


def _through_wire(waveform: bool):
    """Samples written as PB/HTTP chunks, one for each source and type of a batch, and read back: fragments of 4099 bytes go through framing,
    escapes and decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks: dict[tuple[str, str], list[tuple]] = {}
            for r in batch.to_pylist():
                k = r["seq"] % 4
                payload = _SCALARS[k] if not waveform else _SCALARS[k].replace("SCALAR", "WAVEFORM")
                v = (r["value"], int(r["value"] * 100), f"{r['source']}\n\x1b\r", int(r["value"]) - 50)[k]
                chunks.setdefault((r["source"], payload), []).append((r["seq"], r["seconds"] - YEAR, r["nanos"], [v, v + ("x" if k == 2 else 1)] if waveform else v))
            out = []
            for (source, payload), rows in chunks.items():
                chunk = pbhttp.encode_chunk(source, payload, 2024, [r[1:] for r in rows])
                for (seq, *_), s in zip(rows, pbhttp.samples(chunk[i : i + 4099] for i in range(0, len(chunk), 4099)), strict=True):
                    got = next(s[c] for c in s if c.startswith("v_"))
                    for pos, got in enumerate(got if waveform else [got]):
                        out.append({"source": s["pv"], "seq": seq, "pos": pos, "payload": s["payload_type"], "seconds": s["epoch_seconds"], "nanos": s["nanoseconds"], "v_int": got if isinstance(got, int) else None, "v_number": got if isinstance(got, float) else None, "v_text": got if isinstance(got, str) else None})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return run


def _wire_sql(kind: str, positions: int) -> str:
    return f"""WITH {SAMPLES} SELECT source, seq, CAST(pos AS INT) AS pos, '{kind}_' || ['DOUBLE', 'INT', 'STRING', 'SHORT'][seq % 4 + 1] AS payload, seconds, nanos,
 CASE seq % 4 WHEN 1 THEN CAST(trunc(value * 100) AS BIGINT) + pos WHEN 3 THEN CAST(trunc(value) AS BIGINT) - 50 + pos END AS v_int, CASE WHEN seq % 4 = 0 THEN value + pos END AS v_number,
 CASE WHEN seq % 4 = 2 THEN source || chr(10) || chr(27) || chr(13) || CASE WHEN pos = 1 THEN 'x' ELSE '' END END AS v_text FROM samples, range({positions}) AS p(pos)"""


_DDL = "source string, seq long, pos int, payload string, seconds long, nanos int, v_int long, v_number double, v_text string"


@query(_wire_sql("SCALAR", 1))
def cnv_archiver_scalar(spark, d):
    return samples(spark, d).mapInArrow(_through_wire(False), _DDL)


@query(_wire_sql("WAVEFORM", 2))
def cnv_archiver_waveform(spark, d):
    """Every element of every waveform."""
    return samples(spark, d).mapInArrow(_through_wire(True), _DDL)


def _frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            raw = pbhttp.escape(f"{r['props']}\n{r['event_type']}".encode()) + b"\n\n" + pbhttp.escape(b"\x1b\r\n" * (r["event_id"] % 3))
            step = 1 + r["event_id"] % 5
            found = list(pbhttp.lines(raw[i : i + step] for i in range(0, len(raw), step)))
            out.append({"event_id": r["event_id"], "n_lines": len(found), "n_chunks": 1 + (len(found) > 2), "n_bytes": sum(len(pbhttp.unescape(x)) for x in found)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("event_id", pa.int64()), ("n_lines", pa.int64()), ("n_chunks", pa.int64()), ("n_bytes", pa.int64())]))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS n_lines, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_chunks,
 CAST(length(props) + 1 + length(event_type) + 3 * (event_id % 3) AS BIGINT) AS n_bytes FROM events""")
def pb_framing(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "props").mapInArrow(_frame, "event_id long, n_lines long, n_chunks long, n_bytes long")


@query("""SELECT unnest(['name', 'pvs[0].name', 'pvs[1].name', 'pvs[1].option.type', 'tls', 'empty']) AS key, unnest(['r1', 'a:b', 'c:d', 'row-table', 'true', '{}']) AS value""")
def config_flatten(spark, d):
    return config.as_rows(spark, {"name": "r1", "pvs": [{"name": "a:b"}, {"name": "c:d", "option": {"type": "row-table"}}], "tls": True, "empty": {}})


def _stream(spark, d):
    e = replay.file_stream(spark, f"{d}/events.parque[t]")
    return e.select(F.concat(F.lit("EV:"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("seq"), seconds_of("ts").alias("seconds"), nanos_of("ts").alias("nanos"), "value")


@query(f"WITH {SAMPLES} SELECT source, seq, seconds, nanos, value FROM samples")
def src_stream_replay(spark, d):
    out = replay.run_available(_stream(spark, d), replay.working_folder(spark, "replay"))
    return spark.read.parquet(out).drop("batch")


@query(f"""WITH {SAMPLES}, m AS (SELECT *, max(t) OVER (PARTITION BY source ORDER BY (seq * 7919) % 10007, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM samples)
 SELECT source, seq, (seq * 7919) % 10007 AS arrival FROM m WHERE mark IS NULL OR t > mark""")
def stream_dedup_state(spark, d):
    s = _stream(spark, d).withColumn("arrival", F.pmod(F.col("seq") * 7919, F.lit(10007)) * 1_000_000_000 + F.col("seq"))
    out = replay.run_available(replay.newer_only(s, "source", "seconds", "nanos", "arrival"), replay.working_folder(spark, "dedup"))
    return spark.read.parquet(out).select("source", "seq", F.floor(F.col("arrival") / 1_000_000_000).alias("arrival"))
