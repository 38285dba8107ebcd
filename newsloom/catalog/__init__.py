"""Named queries over the given tables, each with SQL to check it against.

Every query reads whole tables.  ``sql`` is a statement for an independent SQL
engine that must return the same rows; queries without one are checked by row
count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql:
            SQL[name] = sql.strip()
        return build

    return register


def load() -> None:
    """Import the modules that register queries."""
    from newsloom.catalog import (  # noqa: F401
        ingest, reports, retrieval, sessions, streams, texts, web,
    )
