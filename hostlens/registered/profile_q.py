"""Registered frame-profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators import profile as P
from hostlens.operators import series as S
from hostlens.registered.common import SQL_MEASUREMENTS, measurements
from hostlens.registry import r6, register, sql_ts, table, ts_text

M = SQL_MEASUREMENTS


def _frame(spark, sf):
    return S.coerce_numeric(measurements(spark, sf), "Value")


@register("p1_row_count", "SELECT count(*) AS n_rows FROM events")
def p1(spark, sf):
    return P.row_count(_frame(spark, sf))


@register("p2_head", f"""SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Hostname", "Series", "Value", pos
FROM {M} m ORDER BY pos LIMIT 5""")
def p2h(spark, sf):
    return P.head(_frame(spark, sf)).withColumn("Timestamp", ts_text("Timestamp"))


@register("p2_tail", f"""SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Hostname", "Series", "Value", pos
FROM {M} m ORDER BY pos DESC LIMIT 5""")
def p2t(spark, sf):
    return P.tail(_frame(spark, sf)).withColumn("Timestamp", ts_text("Timestamp"))


@register("p4_columns", f"""
SELECT unnest([0, 1, 2, 3, 4]) AS position, unnest(['Timestamp', 'Hostname', 'Series', 'Value', 'pos']) AS "column",
  unnest([count("Timestamp"), count("Hostname"), count("Series"), count(CASE WHEN "Series" <> 'error' THEN "Value" END), count(pos)]) AS n_values FROM {M} m""")
def p4(spark, sf):
    df = _frame(spark, sf)
    return P.columns_frame(df.withColumn("Value", F.when(F.col("Series") != "error", F.col("Value"))))


@register("p3_hosts_in_order", f"""
SELECT "Hostname", first_pos, row_number() OVER (ORDER BY first_pos, "Hostname") - 1 AS appearance
FROM (SELECT "Hostname", min(pos) AS first_pos FROM {M} m GROUP BY 1)""")
def p3(spark, sf):
    return P.hosts_in_order(_frame(spark, sf))


@register("p5_first_per_second", f"""
SELECT {sql_ts('date_trunc(\'second\', "Timestamp")')} AS "Timestamp",
  arg_min("Hostname", pos) AS "Hostname", arg_min("Series", pos) AS "Series", arg_min("Value", pos) AS "Value"
FROM {M} m GROUP BY date_trunc('second', "Timestamp")""")
def p5(spark, sf):
    df = _frame(spark, sf).withColumn("Timestamp", F.date_trunc("second", "Timestamp"))
    return P.first_per_time(df).withColumn("Timestamp", ts_text("Timestamp"))


@register("p6_time_span", f"""SELECT {sql_ts('min(ts)')} AS start_time, {sql_ts('max(ts)')} AS end_time FROM events""")
def p6(spark, sf):
    return P.time_span(_frame(spark, sf)).select(ts_text("start_time").alias("start_time"),
                                                 ts_text("end_time").alias("end_time"))


@register("p7_host_profile", f"""
SELECT "Hostname", count(*) AS n_rows, {sql_ts('min("Timestamp")')} AS start_time,
  {sql_ts('max("Timestamp")')} AS end_time, count(*) FILTER (WHERE "Value" IS NULL) AS n_null,
  min("Value") AS min_value, max("Value") AS max_value, round(avg("Value"), 6) AS mean_value
FROM {M} m GROUP BY 1""")
def p7(spark, sf):
    df = P.host_profile(_frame(spark, sf))
    return (df.withColumn("start_time", ts_text("start_time")).withColumn("end_time", ts_text("end_time"))
            .withColumn("mean_value", r6("mean_value")))


@register("p7_lineitem_profile", f"""
SELECT CAST(l_suppkey AS VARCHAR) AS "Hostname", count(*) AS n_rows, {sql_ts('min(l_shipdate)')} AS start_time,
  {sql_ts('max(l_shipdate)')} AS end_time, count(*) FILTER (WHERE l_extendedprice IS NULL) AS n_null,
  min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
  round(avg(l_extendedprice), 6) AS mean_value FROM lineitem GROUP BY 1""")
def p7l(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("Hostname"),
                                             F.col("l_shipdate").alias("Timestamp"),
                                             F.col("l_extendedprice").alias("Value"))
    df = P.host_profile(li)
    return (df.withColumn("start_time", ts_text("start_time")).withColumn("end_time", ts_text("end_time"))
            .withColumn("mean_value", r6("mean_value")))
