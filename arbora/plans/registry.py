"""Registry of named queries over the test tables and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the optional SQL string is the
same computation in ANSI SQL over the pre-registered table views. Double-valued
columns are rounded to 6 decimals on both sides so results compare exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.operators.guards import release

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOTES: dict[str, str] = {}


def query(name: str, sql: str | None = None, note: str | None = None):
    """Register ``fn`` under ``name`` with an optional SQL twin."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        @functools.wraps(fn)
        def run(spark, sf_dir):
            release()   # tables that earlier queries kept
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if note:
            NOTES[name] = note
        return fn
    return deco
