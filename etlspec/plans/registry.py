"""Source and sink kinds. The built-in ones come first; callers may add more."""

from __future__ import annotations

from collections.abc import Callable

# The kinds known without registration.
BUILT_IN_SOURCES = ("s3", "jdbc", "catalog", "kafka", "api")
BUILT_IN_SINKS = ("s3", "jdbc", "catalog", "iceberg")

_sources: dict[str, Callable] = {}
_sinks: dict[str, Callable] = {}


def register_source(kind: str, read: Callable | None = None) -> None:
    """Add a source kind: ``read(spark, source) -> DataFrame``.

    Without ``read`` the kind is taken as the short name of a Spark data
    source and loaded with ``spark.read.format(kind)``.
    """
    if kind in BUILT_IN_SOURCES:
        raise ValueError(f"source kind '{kind}' is built in")
    _sources[kind] = read or _read_by_format


def register_sink(kind: str, write: Callable) -> None:
    """Add a sink kind: ``write(df, sink)``."""
    if kind in BUILT_IN_SINKS:
        raise ValueError(f"sink kind '{kind}' is built in")
    _sinks[kind] = write


def source_kinds() -> tuple[str, ...]:
    return (*BUILT_IN_SOURCES, *_sources)


def sink_kinds() -> tuple[str, ...]:
    return (*BUILT_IN_SINKS, *_sinks)


def added_source(kind: str) -> Callable | None:
    return _sources.get(kind)


def added_sink(kind: str) -> Callable | None:
    return _sinks.get(kind)


def _read_by_format(spark, source):
    from etlspec.sources.files import reader_options

    reader = spark.read.format(source.kind).options(**reader_options(source.options))
    return reader.load(source.path) if source.path else reader.load()
