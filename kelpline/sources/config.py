"""Configuration trees: flattened rows, and typed, validated settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    pass


def flatten(node: Any, path: str = "") -> list[tuple[str, str]]:
    """(key, value) rows of a tree: `a.b[0].c`. Empty maps and lists are rows of their own; null is an empty value."""
    if isinstance(node, dict) and node:
        return [r for k, v in node.items() for r in flatten(v, f"{path}.{k}" if path else str(k))]
    if isinstance(node, list) and node:
        return [r for i, v in enumerate(node) for r in flatten(v, f"{path}[{i}]")]
    text = "{}" if node == {} else "[]" if node == [] else "" if node is None else str(node).lower() if isinstance(node, bool) else str(node)
    return [(path, text)]


def as_rows(spark: SparkSession, tree: Any) -> DataFrame:
    return spark.createDataFrame(flatten(tree), "key string, value string")


def _whole(tree: dict, key: str, default: int, least: int) -> int:
    v = tree.get(key, default)
    if isinstance(v, bool) or not isinstance(v, int) and not (isinstance(v, str) and v.strip().lstrip("-").isdigit()):
        raise ConfigError(f"{key} must be a whole number")
    if int(v) < least:
        raise ConfigError(f"{key} must be {least} or more")
    return int(v)


def _text(tree: dict, key: str) -> str:
    v = tree.get(key)
    if not isinstance(v, str) or not v.strip():
        raise ConfigError(f"{key} is missing or empty")
    return v


def _map(node: Any, what: str) -> dict:
    if not isinstance(node, dict):
        raise ConfigError(f"{what} must be a map")
    return node


@dataclass(frozen=True)
class Source:
    name: str
    mode: str = "default"
    seconds_field: str = "secondsPastEpoch"
    nanos_field: str = "nanoseconds"


@dataclass(frozen=True)
class LiveReader:
    name: str
    sources: tuple[Source, ...] = ()
    threads: int = 1
    column_batch: int = 50
    poll_threads: int = 2
    poll_interval_ms: int = 5

    @classmethod
    def of(cls, node: Any, names: Names | None = None) -> LiveReader:
        names = names or Names()
        tree = _map(node, "reader")
        if "backend" in tree:
            raise ConfigError("backend isn't a setting of readers")
        listed = tree.get("pvs") or []
        if not isinstance(listed, list):
            raise ConfigError("pvs must be a list")
        sources: dict[str, Source] = {}
        for p in listed:
            p = _map(p, "a pvs entry")
            name, option = _text(p, "name"), p.get("option")
            if option is None:
                found = Source(name)
            else:
                option = _map(option, "option")
                kind = _text(option, "type").lower()
                kind = "table" if kind == names.table.lower() else kind
                if kind not in ("default", "table"):
                    raise ConfigError(f"unknown option type {kind}")
                if kind != "default" and "sourceName" in option:
                    raise ConfigError("sourceName doesn't go with tables")
                found = Source(name, kind, option.get("tsSeconds", "secondsPastEpoch"), option.get("tsNanos", "nanoseconds"))
            sources.setdefault(name, found)
        return cls(_text(tree, "name"), tuple(sources.values()), _whole(tree, "thread-pool", 1, 1), _whole(tree, "column-batch-size", 50, 0), _whole(tree, "monitor-poll-threads", 2, 1), _whole(tree, "monitor-poll-interval-ms", 5, 1))


def _date(tree: dict, *keys: str) -> str | None:
    for k in keys:
        if k in tree:
            try:
                datetime.fromisoformat(str(tree[k]).replace("Z", "+00:00"))
            except ValueError as e:
                raise ConfigError(f"{k} isn't a date") from e
            return str(tree[k])
    return None


@dataclass(frozen=True)
class ArchiverReader:
    name: str
    hostname: str
    mode: str = "historical_once"
    start: str | None = None
    end: str | None = None
    batch_s: int = 1
    poll_s: int = 0
    lookback_s: int = 0
    connect_s: int = 30
    total_s: int = 300
    verify_peer: bool = True
    verify_host: bool = True
    pvs: tuple[str, ...] = field(default=())  # as listed: doubles stay

    @classmethod
    def of(cls, node: Any, names: Names | None = None) -> ArchiverReader:
        tree = _map(node, "reader")
        mode = str(tree.get("mode", "historical_once")).lower()
        if mode not in ("historical_once", "periodic_tail"):
            raise ConfigError(f"unknown mode {mode}")
        start, end = _date(tree, "start-date", "startDate"), _date(tree, "end-date", "endDate")
        poll = lookback = 0
        if mode == "historical_once":
            if start is None:
                raise ConfigError("start-date is missing")
        else:
            poll = _whole(tree, "poll-interval-sec", 0, 1)
            lookback = _whole(tree, "lookback-sec", poll, 1)
            if lookback > poll:
                raise ConfigError("lookback-sec must not exceed poll-interval-sec")
        connect, total = _whole(tree, "connect-timeout-sec", 30, 1), _whole(tree, "total-timeout-sec", 300, 0)
        if total and total < connect:
            raise ConfigError("total-timeout-sec must be 0 or at least connect-timeout-sec")
        peer, host = tree.get("tls-verify-peer", True), tree.get("tls-verify-host", True)
        if host and not peer:
            raise ConfigError("tls-verify-host needs tls-verify-peer")
        if not isinstance(tree.get("pvs"), list):
            raise ConfigError("pvs must be a list")
        pvs = tuple(_text(_map(p, "a pvs entry"), "name") for p in tree["pvs"])
        return cls(_text(tree, "name"), _text(tree, "hostname"), mode, start, end, _whole(tree, "batch-duration-sec", 1, 1), poll, lookback, connect, total, bool(peer), bool(host), pvs)


@dataclass(frozen=True)
class Pool:
    provider: str
    ingestion_url: str
    query_url: str
    least: int = 1
    most: int = 1
    credentials: str = "none"

    @classmethod
    def of(cls, node: Any) -> Pool:
        tree = _map(node, "the pool")
        a, b = _text(tree, "ingestion-url"), _text(tree, "query-url")
        if a == b:
            raise ConfigError("the two URLs must differ")
        least, most = _whole(tree, "min-conn", 1, 1), _whole(tree, "max-conn", 1, 1)
        if least > most:
            raise ConfigError("min-conn must not exceed max-conn")
        cred = tree.get("credentials", "none")
        if not isinstance(cred, dict) and cred not in ("none", "ssl"):
            raise ConfigError("credentials must be none, ssl or a map")
        return cls(_text(tree, "provider-name"), a, b, least, most, "map" if isinstance(cred, dict) else cred)


@dataclass(frozen=True)
class Names:
    """What a site calls the pool, the table option and the kinds of readers. Other names are refused."""

    pool: str = "service-pool"
    table: str = "row-table"
    archivers: tuple[str, ...] = ("archiver",)
    live: tuple[str, ...] = ("live",)


@dataclass(frozen=True)
class Controller:
    workers: int
    stream_max_bytes: int
    stream_max_age_ms: int
    pool: Pool
    readers: tuple[Any, ...] = ()
    scan_interval_s: int = 1

    @classmethod
    def of(cls, node: Any, names: Names | None = None) -> Controller:
        names = names or Names()
        tree = _map(node, "configuration")
        readers: list[Any] = []
        listed = tree.get("reader", [])
        if not isinstance(listed, list):
            raise ConfigError("reader must be a list")
        for entry in listed:
            for kind, nodes in _map(entry, "a reader entry").items():
                if kind not in names.archivers + names.live:
                    raise ConfigError(f"unknown reader {kind}")
                of = ArchiverReader if kind in names.archivers else LiveReader
                readers += [of.of(n, names) for n in (nodes if isinstance(nodes, list) else [nodes])]
        called = [r.name for r in readers]
        if len(called) != len(set(called)):
            raise ConfigError("reader names must differ")
        metrics = _map(tree.get("metrics", {}), "metrics")
        return cls(_whole(tree, "controller-thread-pool", 1, 1), _whole(tree, "controller-stream-max-bytes", 2 << 20, 1), _whole(tree, "controller-stream-max-age-ms", 200, 1), Pool.of(tree.get(names.pool)), tuple(readers), _whole(metrics, "scan-interval-seconds", 1, 1))
