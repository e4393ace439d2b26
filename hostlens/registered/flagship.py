"""The flagship series query used by ``entry``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import series as S
from hostlens.registered.common import building_hosts, measurements
from hostlens.registry import register, sql_ts, ts_text

START, END = "2024-01-02 00:00:00", "2024-01-20 00:00:00"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measurements(spark, sf_dir)
    df = S.select_hosts(df, building_hosts(spark, sf_dir))                # Q1
    df = S.coerce_numeric(df, "Value")                                    # Q4
    df = S.time_range(S.time_index(df, "Timestamp"), "Timestamp", START, END)  # Q5, Q6
    df = S.positional_buckets(df, 30, "last")                             # Q8a
    # Q12: per-host buckets are numbered densely from 0, so the bucket is the ordinal x
    return df.select("Hostname", F.col("bucket").alias("x"), ts_text("Timestamp").alias("Timestamp"), "Series",
                     F.col("Value"), "pos")


register("flagship_series", f"""
WITH f AS (SELECT ts, CAST(user_id AS VARCHAR) AS h, event_type, value, event_id FROM events
           WHERE CAST(user_id AS VARCHAR) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')
             AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ts, event_id) - 1 AS rn FROM f),
b AS (SELECT h, rn // 2 AS bucket, arg_max(ts, rn) AS ts, arg_max(event_type, rn) AS et,
             arg_max(value, rn) AS v, arg_max(event_id, rn) AS pos FROM r GROUP BY h, rn // 2)
SELECT h AS "Hostname", row_number() OVER (PARTITION BY h ORDER BY bucket) - 1 AS x,
  {sql_ts('ts')} AS "Timestamp", et AS "Series", v AS "Value", pos FROM b""")(flagship)
