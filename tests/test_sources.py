"""Framing, wire format, HTTP, registry and configuration."""

import gzip
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.sources import config, http, pbhttp, registry


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200))
def test_escapes_round_trip(raw):
    line = pbhttp.escape(raw)
    assert b"\n" not in line and b"\r" not in line
    assert pbhttp.unescape(line) == raw


@pytest.mark.parametrize("bad", [b"abc\x1b", b"\x1b\x09"])
def test_bad_escapes(bad):
    with pytest.raises(ValueError):
        pbhttp.unescape(bad)


VALUES = {"SCALAR_STRING": "é\n", "SCALAR_SHORT": -42, "SCALAR_FLOAT": 0.5, "SCALAR_ENUM": 3, "SCALAR_BYTE": b"\xde\xad", "SCALAR_INT": -(1 << 31), "SCALAR_DOUBLE": 3.14, "WAVEFORM_STRING": ["a", ""], "WAVEFORM_SHORT": [1, -2, 30000], "WAVEFORM_FLOAT": [0.25, -1.5], "WAVEFORM_ENUM": [0, 1], "WAVEFORM_BYTE": b"\xbe\xef", "WAVEFORM_INT": [0x7FFFFFFF, -1], "WAVEFORM_DOUBLE": [1.0, 2.0], "V4_GENERIC_BYTES": b"\x00\x1b\n"}


@pytest.mark.parametrize("payload", pbhttp.TYPES)
@pytest.mark.parametrize("step", [1, 7, 4096])
def test_payloads(payload, step):
    raw = pbhttp.encode_chunk("x:y", payload, 2000, [(5, 7, VALUES[payload]), (6, 0, VALUES[payload])])
    got = list(pbhttp.samples(raw[i : i + step] for i in range(0, len(raw), step)))
    assert [(s["epoch_seconds"], s["nanoseconds"]) for s in got] == [(946684805, 7), (946684806, 0)]
    assert next(v for k, v in got[0].items() if k.startswith("v_")) == VALUES[payload]


def test_two_chunks_and_no_final_line_end():
    raw = pbhttp.encode_chunk("a", "SCALAR_INT", 2023, [(1, 0, 1)]) + pbhttp.encode_chunk("a", "SCALAR_INT", 2024, [(1, 0, 2)]).rstrip(b"\n")
    got = list(pbhttp.samples([raw]))
    assert [(s["chunk_id"], s["v_int"]) for s in got] == [(0, 1), (1, 2)]


def test_old_year_and_cut_message():
    with pytest.raises(ValueError):
        list(pbhttp.samples([pbhttp.encode_chunk("a", "SCALAR_INT", 1969, [(1, 0, 1)])]))
    with pytest.raises(ValueError):
        list(pbhttp.fields(b"\x0a\x05ab"))


class Archive(BaseHTTPRequestHandler):
    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        pv = q["pv"][0]
        if pv == "missing":
            self.send_response(404)
            self.end_headers()
            self.wfile.write(pbhttp.encode_chunk(pv, "SCALAR_DOUBLE", 2024, [(1, 0, 1.0)]))
            return
        body = gzip.compress(pbhttp.encode_chunk(pv, "SCALAR_DOUBLE", 2024, [(k, 0, k / 2) for k in range(10)]))
        self.send_response(200)
        self.send_header("Content-Encoding", "gzip")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def archive():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def test_archiver_reads_sources_in_parallel(spark, archive):
    df = registry.create("archiver", spark, **{"hostname": archive, "pvs": "a:1, b c", "from": "2024-01-01T00:00:00.000Z"})
    assert df.rdd.getNumPartitions() == 2
    got = df.select("pv", "v_double").collect()
    assert len(got) == 20 and {r.pv for r in got} == {"a:1", "b c"}


def test_an_error_passes_nothing_on(archive):
    url = http.request_url(archive, "missing", "2024")
    with pytest.raises(urllib.error.HTTPError):
        next(http.stream(url))


def test_urls():
    assert http.request_url("h//", "a b", "x", "y") == "http://h/retrieval/data/getData.raw?pv=a%20b&from=x&to=y"
    assert http.base_url("https://h/") == "https://h"


def test_registry():
    with pytest.raises(ValueError, match="unknown reader type"):
        registry.create("nothing")
    assert "archiver" in registry.registered()


GOOD = {
    "service-pool": {"provider-name": "p", "ingestion-url": "a", "query-url": "b", "min-conn": 1, "max-conn": 2},
    "reader": [{"live": [{"name": "r", "pvs": [{"name": "x"}, {"name": "x"}, {"name": "t", "option": {"type": "ROW-TABLE"}}]}]}, {"archiver": [{"name": "h", "hostname": "z", "start-date": "2024-01-01T00:00:00Z", "pvs": []}]}],
}


def test_configuration():
    c = config.Controller.of(GOOD)
    live, past = c.readers
    assert [s.mode for s in live.sources] == ["default", "table"] and live.column_batch == 50
    assert past.pvs == () and past.mode == "historical_once" and c.stream_max_age_ms == 200


def test_names_are_parameters():
    tree = {"a-pool": GOOD["service-pool"], "reader": [{"one-live": [{"name": "r", "pvs": [{"name": "t", "option": {"type": "wide"}}]}]}]}
    c = config.Controller.of(tree, config.Names(pool="a-pool", table="wide", live=("one-live",)))
    assert c.readers[0].sources[0].mode == "table"
    for wrong in ({"reader": [{"x-live": []}]}, {"reader": [{"live": [{"name": "r", "pvs": [{"name": "t", "option": {"type": "other-table"}}]}]}]}, {"service-pool": None, "other-pool": GOOD["service-pool"]}):
        with pytest.raises(config.ConfigError):
            config.Controller.of(GOOD | wrong)


@pytest.mark.parametrize(
    "change",
    [
        lambda g: g.update({"controller-thread-pool": 0}),
        lambda g: g.update({"reader": {}}),
        lambda g: g["service-pool"].update({"query-url": "a"}),
        lambda g: g["service-pool"].update({"max-conn": 0}),
        lambda g: g["reader"].append({"other": [{}]}),
        lambda g: g["reader"][0]["live"][0].update({"backend": "x"}),
        lambda g: g["reader"][0]["live"][0]["pvs"][2]["option"].update({"sourceName": "s"}),
        lambda g: g["reader"][1]["archiver"][0].pop("start-date"),
        lambda g: g["reader"][1]["archiver"][0].update({"mode": "periodic_tail", "poll-interval-sec": 5, "lookback-sec": 6}),
        lambda g: g["reader"][1]["archiver"][0].update({"tls-verify-peer": False}),
        lambda g: g["reader"][1]["archiver"][0].update({"total-timeout-sec": 5}),
        lambda g: g["reader"][1]["archiver"][0].update({"batch-duration-sec": 0.1}),
        lambda g: g["reader"][1]["archiver"][0].pop("pvs"),
    ],
)
def test_bad_configuration(change):
    import copy

    tree = copy.deepcopy(GOOD)
    change(tree)
    with pytest.raises(config.ConfigError):
        config.Controller.of(tree)
