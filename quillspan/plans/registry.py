"""Name → (DataFrame builder, equivalent SQL) for every published query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Publish a builder under ``name``; ``sql`` states the same result for DuckDB."""

    def publish(builder: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is published twice")
        _BUILDERS[name] = builder
        if sql is not None:
            _SQL[name] = sql
        return builder

    return publish


def builders() -> dict[str, Builder]:
    return dict(_BUILDERS)


def oracles() -> dict[str, str]:
    return dict(_SQL)
