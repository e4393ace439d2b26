"""Registry of named queries: a Spark plan and its DuckDB oracle SQL.

Every registered query reads the driver tables (or data Spark derives from
them) in full.  ``sql`` is None for queries with no SQL equivalent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS_TEXT = "%Y-%m-%d %H:%M:%S.%f"


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Registered(name, fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, Registered]:
    # import for side effects (registration)
    from hostlens.registered import (  # noqa: F401
        changes_q, fetch_q, flagship, ingest_q, ordering_q, profile_q, relational_q, series_q, stream_q)
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ts_text(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, TS_TEXT)


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '{SQL_TS_TEXT}')"


def r6(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6)
