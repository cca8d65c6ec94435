"""The archiver followed live against a mock server: joined windows, shorter lookbacks, batch spans, no duplicates, restarts."""

import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from kelpline.sources import pbhttp
from kelpline.streaming import tail


class Live(BaseHTTPRequestHandler):
    """A sample of every source each quarter of a second; the one that held before the window comes first, as archivers answer."""

    asked: list = []

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        at = [datetime.fromisoformat(q[k][0].replace("Z", "+00:00")).timestamp() for k in ("from", "to")]
        Live.asked.append((q["pv"][0], round(at[0] * 1000), round(at[1] * 1000)))
        first, last = int(at[0] * 4), int(at[1] * 4 - 1e-9)
        year = datetime.fromisoformat(q["to"][0].replace("Z", "+00:00")).year
        base = int(datetime.fromisoformat(f"{year}-01-01T00:00:00+00:00").timestamp())
        rows = [(k // 4 - base, k % 4 * 250_000_000, float(k)) for k in range(first, last + 1)]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(pbhttp.encode_chunk(q["pv"][0], "SCALAR_DOUBLE", year, rows))

    def log_message(self, *_):
        pass


@pytest.fixture()
def live():
    Live.asked = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Live)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def follow(spark, folder, live, windows, **options):
    query = tail.follow(spark, folder, 1, "p", hostname=live, pvs="a:1, b", **options)
    end = time.monotonic() + 60
    while len([x for x in Live.asked if x[0] == "b"]) < windows and time.monotonic() < end and query.isActive:
        time.sleep(0.05)
    time.sleep(1.5)
    query.stop()
    assert query.exception() is None
    return sorted({x[1:] for x in Live.asked if x[0] == "b"})


def test_windows_join_and_nothing_comes_twice(spark, live, tmp_path):
    folder = f"file://{tmp_path}/t"
    asked = follow(spark, folder, live, 3, poll_s="2")
    assert len(asked) >= 3
    assert all(a[1] == b[0] for a, b in zip(asked, asked[1:]))
    samples = spark.read.parquet(f"{folder}/samples")
    got = samples.groupBy("pv").agg(F.count("*").alias("n"), F.countDistinct("v_double").alias("d"), F.min("v_double").alias("lo"), F.max("v_double").alias("hi")).collect()
    assert {r.pv for r in got} == {"a:1", "b"}
    assert all(r.n == r.d == r.hi - r.lo + 1 for r in got)
    # After a restart the next window begins where the last ended, however long ago that was.
    last = max(t for _, t in asked)
    Live.asked = []
    time.sleep(1)
    again = follow(spark, folder, live, 1, poll_s="2")
    assert min(f for f, _ in again) <= last and any(f == last for f, _ in again)
    got = spark.read.parquet(f"{folder}/samples").groupBy("pv").agg(F.count("*").alias("n"), F.countDistinct("v_double").alias("d"), F.min("v_double").alias("lo"), F.max("v_double").alias("hi")).collect()
    assert all(r.n == r.d == r.hi - r.lo + 1 for r in got)


def test_batches_span_no_more_than_asked(spark, live, tmp_path):
    folder = f"file://{tmp_path}/t"
    follow(spark, folder, live, 2, poll_s="3")
    frames = spark.read.parquet(f"{folder}/frames").collect()
    ns = lambda t: t.epoch_seconds * 10**9 + t.nanoseconds
    assert len(frames) > 2
    assert all(ns(r.ts_list[-1]) - ns(r.ts_list[0]) <= 10**9 for r in frames)
    assert sum(len(r.ts_list) for r in frames) == spark.read.parquet(f"{folder}/samples").count()
    sent = spark.read.parquet(f"{folder}/requests")
    assert sent.count() == len(frames) == sent.select("request_id").distinct().count()


def test_a_shorter_lookback_leaves_gaps(spark, live, tmp_path):
    asked = follow(spark, f"file://{tmp_path}/t", live, 2, poll_s="3", lookback_s="1")
    assert all(t - f == 1000 for f, t in asked)
    assert all(b[0] > a[1] for a, b in zip(asked, asked[1:]))


def test_a_longer_lookback_is_refused():
    with pytest.raises(ValueError):
        pbhttp.PbHttpTail({"poll_s": "2", "lookback_s": "3", "pvs": "a", "hostname": "h"})


def test_polls_keep_apart(monkeypatch):
    """Triggers are aligned to multiples of their interval, so that the second may follow the first at once."""
    now = [1_700_000_000_000]
    monkeypatch.setattr(pbhttp.time, "time_ns", lambda: now[0] * 1_000_000)
    reader = pbhttp.PbHttpTail({"poll_s": "3", "lookback_s": "1", "pvs": "a", "hostname": "h"})
    ends = []
    for step in (0, 400, 2600, 3000, 3010, 2990, 100):
        now[0] += step
        ends.append(reader.latestOffset()["to_ms"] - 1_700_000_000_000)
    assert ends == [0, 0, 3000, 6000, 9010, 12000, 12000]
    (one,) = reader.partitions({"to_ms": 0}, {"to_ms": 5000})
    assert (one.begin, one.end) == (pbhttp.iso_millis(4000), pbhttp.iso_millis(5000))
