"""Frame profile (P1-P7): what the reference shows after building a frame.

All of it is aggregation; nothing is collected inside the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.operators.scan import ordinal


def row_count(df: DataFrame) -> DataFrame:
    """P1."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def head(df: DataFrame, pos_col: str = "pos", n: int = 5) -> DataFrame:
    """First n rows in frame order (top-k, no full sort)."""
    return df.orderBy(F.col(pos_col).asc()).limit(n)


def tail(df: DataFrame, pos_col: str = "pos", n: int = 5) -> DataFrame:
    """Last n rows in frame order."""
    return df.orderBy(F.col(pos_col).desc()).limit(n)


def hosts_in_order(df: DataFrame, host_col: str = "Hostname", pos_col: str = "pos") -> DataFrame:
    """Distinct hosts with the rank of their first appearance."""
    first = df.groupBy(host_col).agg(F.min(pos_col).alias("first_pos"))
    return ordinal(first, None, [F.col("first_pos"), F.col(host_col)], name="appearance")


def columns_frame(df: DataFrame) -> DataFrame:
    """The frame's columns in order, each with its number of values, in one pass."""
    one = df.agg(*[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n_values"))
                                          for i, c in enumerate(df.columns)])).alias("c")).select("c.*")


def first_per_time(df: DataFrame, time_col: str = "Timestamp", pos_col: str = "pos") -> DataFrame:
    """P5: for each timestamp, the first non-null value of every other column."""
    others = [c for c in df.columns if c not in (time_col, pos_col)]
    return df.groupBy(time_col).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos_col))).alias(c) for c in others])


def time_span(df: DataFrame, time_col: str = "Timestamp") -> DataFrame:
    """Start and end on real timestamps (not text order)."""
    return df.agg(F.min(time_col).alias("start_time"), F.max(time_col).alias("end_time"))


def host_profile(df: DataFrame, host_col: str = "Hostname", time_col: str = "Timestamp",
                 value_col: str = "Value") -> DataFrame:
    """The whole profile per host in one aggregation pass."""
    return df.groupBy(host_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time_col).alias("start_time"),
        F.max(time_col).alias("end_time"),
        F.count_if(F.col(value_col).isNull()).alias("n_null"),
        F.min(value_col).alias("min_value"),
        F.max(value_col).alias("max_value"),
        F.avg(value_col).alias("mean_value"))
