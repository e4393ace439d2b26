"""Shared derivations of the driver tables used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.registry import table


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a measurement frame (host = user_id, plot = value as text,
    selected = event_type, frame order = event_id)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("ts").alias("Timestamp"),
                     F.col("user_id").cast("string").alias("Hostname"),
                     F.col("event_type").alias("Series"),
                     F.col("value").cast("string").alias("Value"),
                     F.col("event_id").alias("pos"))


# The same frame in SQL (DuckDB), for the oracles.
SQL_MEASUREMENTS = """(SELECT ts AS "Timestamp", CAST(user_id AS VARCHAR) AS "Hostname",
  event_type AS "Series", value AS "Value", event_id AS pos FROM events)"""


def building_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host list held as a table: customers of one market segment."""
    return (table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
            .select(F.col("c_custkey").cast("string").alias("host")))


SQL_BUILDING_HOSTS = "(SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')"
