"""Readers by type name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_readers: dict[str, Callable[..., Any]] = {}


def register(name: str, factory: Callable[..., Any]) -> None:
    _readers[name] = factory


def create(name: str, *args: Any, **options: Any) -> Any:
    if name not in _readers:
        raise ValueError(f"unknown reader type {name!r}; known: {', '.join(registered())}")
    return _readers[name](*args, **options)


def registered() -> list[str]:
    return sorted(_readers)


def archiver(spark, **options: str):
    """A batch read of archived samples."""
    from kelpline.sources.pbhttp import PbHttpSource

    spark.dataSource.register(PbHttpSource)
    return spark.read.format("pbhttp").options(**options).load()


def archiver_tail(spark, **options: str):
    """A stream of archived samples, followed window by window."""
    from kelpline.sources.pbhttp import PbHttpSource

    spark.dataSource.register(PbHttpSource)
    return spark.readStream.format("pbhttp").options(**options).load()


register("archiver", archiver)
register("archiver_tail", archiver_tail)
