"""Streaming GET with timeouts, a stall limit, redirects, compression and TLS switches."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote


@dataclass(frozen=True)
class HttpOptions:
    connect_s: float = 30.0
    total_s: float = 300.0  # 0: no limit
    stall_bytes: int = 1024  # fewer a second for stall_s end the transfer
    stall_s: float = 60.0
    redirects: int = 5
    verify_peer: bool = True
    verify_host: bool = True

    @classmethod
    def of(cls, options: dict[str, str]) -> HttpOptions:
        flag = lambda k: options.get(k, "true").lower() != "false"
        return cls(connect_s=float(options.get("connect-timeout-sec", 30)), total_s=float(options.get("total-timeout-sec", 300)), verify_peer=flag("tls-verify-peer"), verify_host=flag("tls-verify-host"))


def base_url(host: str) -> str:
    host = host.rstrip("/")
    return host if "://" in host else f"http://{host}"


def request_url(host: str, pv: str, begin: str, end: str | None = None) -> str:
    enc = lambda s: quote(s, safe="-_.~")
    return f"{base_url(host)}/retrieval/data/getData.raw?pv={enc(pv)}&from={enc(begin)}" + (f"&to={enc(end)}" if end else "")


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections = most


def stream(url: str, options: HttpOptions = HttpOptions(), size: int = 1 << 16) -> Iterator[bytes]:
    """The body in pieces. The status is looked at first: of an answer other than 200 nothing is passed on. A cancelled task closes the
    generator, and with it the connection."""
    context = ssl.create_default_context()
    context.check_hostname = options.verify_host and options.verify_peer
    if not options.verify_peer:
        context.verify_mode = ssl.CERT_NONE
    opener = urllib.request.build_opener(_Redirects(options.redirects), urllib.request.HTTPSHandler(context=context))
    request = urllib.request.Request(url, headers={"Accept-Encoding": "gzip, deflate"})
    began = time.monotonic()
    with opener.open(request, timeout=options.connect_s) as answer:
        if answer.status != 200:
            raise urllib.error.HTTPError(url, answer.status, answer.reason, answer.headers, None)
        unpack = zlib.decompressobj(47) if answer.headers.get("Content-Encoding") in ("gzip", "deflate") else None
        mark, got = time.monotonic(), 0
        while piece := answer.read1(size):
            got += len(piece)
            now = time.monotonic()
            if options.total_s and now - began > options.total_s:
                raise TimeoutError(f"{url}: over {options.total_s:g} s")
            if now - mark >= options.stall_s:
                if got < options.stall_bytes * (now - mark):
                    raise TimeoutError(f"{url}: under {options.stall_bytes} bytes a second")
                mark, got = now, 0
            yield unpack.decompress(piece) if unpack else piece
        if unpack and (rest := unpack.flush()):
            yield rest
