"""Series query operators (Q1-Q13) over a measurement frame.

A measurement frame has a time column, a host column, a selected (series)
column, a plot column and a unique position column (``pos``) that gives the
frame order.  Every function is DataFrame-in / DataFrame-out.  Those that need
row positions (Q7, positional Q8 and Q10, Q12) count and write sorted slices when
they are called (``scan.keyed_scan``); the others are lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.functions.timefmt import parse_time
from hostlens.operators.scan import keyed_scan, ordinal

# Fixed value: the sample period the positional buckets assume (seconds).
SAMPLE_PERIOD = 15
AGGREGATIONS = ("last", "first", "min", "max", "average", "mean")


# Q1 -------------------------------------------------------------------------
def select_hosts(df: DataFrame, hosts=None, host_col: str = "Hostname") -> DataFrame:
    """Keep rows whose host is in ``hosts``; None / empty = all rows.

    ``hosts`` may be a string, a list, or a one-column DataFrame (semi join, so
    the list never passes through the driver).
    """
    if hosts is None:
        return df
    if isinstance(hosts, DataFrame):
        h = hosts.select(F.col(hosts.columns[0]).cast("string").alias(host_col)).distinct()
        return df.join(h, host_col, "left_semi")
    if isinstance(hosts, str):
        hosts = [hosts]
    hosts = [h for h in hosts if h is not None and h != ""]
    if not hosts:
        return df
    return df.where(F.col(host_col).isin(hosts))


# Q2 / Q3 / Q4 ----------------------------------------------------------------
def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """Q2: rows whose ``col`` equals ``value``, compared in the column's type; a value that is none of
    that type equals nothing.  A blank value filters nothing."""
    if value is None or value == "":
        return df
    kind = df.schema[col].dataType
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if number and isinstance(kind, T.NumericType):
        return df.where(F.col(col) == F.lit(value))
    text = str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(kind, T.StringType):
        return df.where(F.col(col) == F.lit(text))
    return df.where(F.col(col) == F.lit(text).try_cast(kind))


def project(df: DataFrame, index: str | None, selected: str, plot: str, keep: Sequence[str] = ()) -> DataFrame:
    cols = ([index] if index else []) + [selected, plot] + [k for k in keep if k not in (index, selected, plot)]
    return df.select(*cols)


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """Q4: text to double, bad text to null."""
    return df.withColumn(col, F.trim(F.col(col).cast("string")).try_cast("double"))


# Q5 / Q6 -------------------------------------------------------------------
def time_index(df: DataFrame, col: str) -> DataFrame:
    """Q5: make the index a timestamp when it parses (typed columns pass through)."""
    t = dict(df.dtypes)[col]
    if t.startswith("timestamp"):
        return df
    return df.withColumn(col, parse_time(F.col(col)))


def time_range(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    """Q6: closed range ``start <= t <= end``; a missing bound is open."""
    c = F.col(col)
    if start not in (None, ""):
        df = df.where(c >= F.lit(start).cast("timestamp_ntz") if isinstance(start, str) else c >= F.lit(start))
    if end not in (None, ""):
        df = df.where(c <= F.lit(end).cast("timestamp_ntz") if isinstance(end, str) else c <= F.lit(end))
    return df


# Q8 ------------------------------------------------------------------------
def bucket_rows(interval) -> int:
    """Rows per positional bucket, or 0 when rows pass through."""
    try:
        interval = int(interval)
    except (TypeError, ValueError):
        return 0
    if interval > SAMPLE_PERIOD and interval % SAMPLE_PERIOD == 0:
        return interval // SAMPLE_PERIOD
    return 0


def _aggregate(df: DataFrame, keys: Sequence[str], rank: Column, aggregation: str,
               time_col: str, value_cols: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    agg = (aggregation or "").lower()
    others = [c for c in df.columns if c not in keys and not c.startswith("_")]
    if agg in ("last", "first"):
        row = F.struct(*[F.col(c) for c in others])
        pick = F.max_by(row, rank) if agg == "last" else F.min_by(row, rank)
        return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")
    if agg in ("min", "max"):
        f = F.min if agg == "min" else F.max
        return df.groupBy(*keys).agg(*[f(c).alias(c) for c in others])
    if agg in ("average", "mean"):
        exprs = ([F.min(time_col).alias(time_col)] + [F.min_by(F.col(c), rank).alias(c) for c in carry]
                 + [F.avg(c).alias(c) for c in value_cols])
        return df.groupBy(*keys).agg(*exprs)
    raise ValueError(f"unknown aggregation {aggregation!r}")


def positional_buckets(df: DataFrame, interval, aggregation: str, *, key: str | None = "Hostname",
                       time_col: str = "Timestamp", pos_col: str = "pos",
                       value_cols: Sequence[str] = ("Value",), partitions: int | None = None,
                       order: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Q8: bucket = position // (interval // 15) within a host (or the frame, ``key=None``).

    Rows pass through when the interval is not a multiple above 15 or the
    aggregation is unknown/blank.  Positions come from ``ordinal`` (range
    partitioned), so one large host never sits in one task.
    """
    k = bucket_rows(interval)
    if not k or (aggregation or "").lower() not in AGGREGATIONS:
        return df
    order = list(order) if order else [time_col, pos_col]
    ranked = ordinal(df, key, order, name="_rn", partitions=partitions, total="_of")
    ranked = ranked.withColumn("bucket", F.floor(F.col("_rn") / F.lit(k)).cast("bigint"))
    if aggregation.lower() in ("first", "last"):
        # the first and last rows of buckets are known by their positions: nothing is grouped
        at = F.pmod(F.col("_rn"), F.lit(k))
        ranked = ranked.where(at == 0 if aggregation.lower() == "first" else (at == k - 1) | (F.col("_rn") == F.col("_of") - 1))
        keys = ([key] if key else []) + ["bucket"]
        return ranked.select(*keys, *[c for c in ranked.columns if c not in keys and not c.startswith("_")])
    ranked = ranked.drop("_of")
    keys = ([key] if key else []) + ["bucket"]
    return _aggregate(ranked, keys, F.col("_rn"), aggregation, time_col, value_cols, carry)


def frame_buckets(df: DataFrame, interval, aggregation: str, *, pos_col: str = "pos",
                  time_col: str = "Timestamp", value_cols: Sequence[str] = ("Value",),
                  partitions: int | None = None) -> DataFrame:
    """Q8 with ``bucket_scope='frame'``: positions over the whole filtered frame in frame order."""
    return positional_buckets(df, interval, aggregation, key=None, time_col=time_col, pos_col=pos_col,
                              value_cols=value_cols, partitions=partitions, order=[pos_col])


# Q9 ------------------------------------------------------------------------
def time_buckets(df: DataFrame, seconds: int, aggregation: str, *, key: str | None = "Hostname",
                 time_col: str = "Timestamp", pos_col: str = "pos",
                 value_cols: Sequence[str] = ("Value",)) -> DataFrame:
    """Q9: epoch-aligned buckets of ``seconds`` per host.  Partial aggregation
    map-side; a hot host spreads over its many buckets."""
    agg = (aggregation or "").lower()
    if not seconds or int(seconds) <= 0 or agg not in AGGREGATIONS:
        return df
    b = df.withColumn("bucket_start", F.window(F.col(time_col), f"{int(seconds)} seconds").start)
    keys = ([key] if key else []) + ["bucket_start"]
    rank = F.struct(F.col(time_col), F.col(pos_col))
    return _aggregate(b, keys, rank, agg, time_col, value_cols)


def time_bucket_stats(df: DataFrame, seconds: int, *, key: str = "Hostname", time_col: str = "Timestamp",
                      value_col: str = "Value") -> DataFrame:
    """All five aggregations of Q9 in one pass (count, min, max, mean, first, last)."""
    b = df.withColumn("bucket_start", F.window(F.col(time_col), f"{int(seconds)} seconds").start)
    rank = F.struct(F.col(time_col), F.col("pos"))
    return b.groupBy(key, "bucket_start").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value_col).alias("min_value"),
        F.max(value_col).alias("max_value"),
        F.avg(value_col).alias("mean_value"),
        F.min_by(F.col(value_col), rank).alias("first_value"),
        F.max_by(F.col(value_col), rank).alias("last_value"))


# Q10 / Q12 -------------------------------------------------------------------
def ordinal_x(df: DataFrame, key: str | None, order: Sequence[str], name: str = "x",
              partitions: int | None = None) -> DataFrame:
    """Q12: replace time by 0..n-1 within each series."""
    return ordinal(df, key, list(order), name=name, partitions=partitions)


def grouped_series(df: DataFrame, selected: str, seconds: int, aggregation: str, *,
                   time_col: str = "Timestamp", pos_col: str = "pos",
                   value_cols: Sequence[str] = ("Value",), positional: bool = False) -> DataFrame:
    """Q10: one line per value of the selected column, after bucketing, with the
    ordinal x of each point inside its line.  Buckets are time buckets of each
    line, or with ``positional`` buckets of the frame's rows before grouping."""
    if positional:
        rows = positional_buckets(df, seconds, aggregation, key=None, time_col=time_col, pos_col=pos_col,
                                  value_cols=value_cols, order=[pos_col], carry=(selected,))
        order = [c for c in ("bucket", pos_col) if c in rows.columns]
        return ordinal(rows, selected, order, name="x")
    b = time_buckets(df, seconds, aggregation, key=selected, time_col=time_col, pos_col=pos_col,
                     value_cols=value_cols)
    return ordinal(b, selected, ["bucket_start"], name="x")


# Q11 -----------------------------------------------------------------------
def pivot_wide(df: DataFrame, row_key: Column | str, pivot_col: str, values: Sequence, value_col: str,
               agg: str = "first", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Q11: one column per pivot value aligned on ``row_key``; the values are
    passed in so Spark skips the distinct-values job.  ``first`` is the value at
    the smallest ``order``; rows of other pivot values make no column."""
    rk = F.col(row_key) if isinstance(row_key, str) else row_key
    if agg == "first":
        made = F.min_by(value_col, F.struct(*order))
    else:
        made = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[agg](value_col)
    return df.groupBy(rk.alias("row_key")).pivot(pivot_col, list(values)).agg(made)


def pivot_left(df: DataFrame, row_key: Column | str, pivot_col: str, values: Sequence, value_col: str,
               agg: str = "first", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Q11, left to the first value: only row keys at which the first of ``values`` has a row."""
    rk = F.col(row_key) if isinstance(row_key, str) else row_key
    keys = df.where(F.col(pivot_col) == F.lit(values[0])).select(rk.alias("row_key")).distinct()
    return pivot_wide(df, row_key, pivot_col, values, value_col, agg, order).join(keys, "row_key", "left_semi")


def pivot_values(df: DataFrame, pivot_col: str, most: int = 1000) -> list:
    """The values to pivot by, sorted; an error beyond ``most``, as columns are a plan-time matter."""
    found = [r[0] for r in df.select(pivot_col).where(F.col(pivot_col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {pivot_col} to pivot by")
    return sorted(found)


# Q13 -----------------------------------------------------------------------
def hour_ticks(df: DataFrame, key: str = "Hostname", time_col: str = "Timestamp",
               max_labels: int = 0) -> DataFrame:
    """Q13: whole-hour offsets from each series start to its end, thinned to at
    most ``max_labels`` labels (0: all)."""
    span = df.groupBy(key).agg(F.min(time_col).alias("start"), F.max(time_col).alias("end"))
    hours = F.floor(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")) / F.lit(3_600_000_000)).cast("int")
    # labels 0, step, 2 step, ...: floor(hours / step) + 1 of them
    step = F.greatest(F.ceil((hours + 1) / F.lit(max_labels)), F.lit(1)).cast("int") if max_labels else F.lit(1)
    return (span.withColumn("hours", hours)
            .select(key, "start", F.explode(F.sequence(F.lit(0), F.col("hours"), step)).alias("tick_hour")))
