"""Registered series queries (Q1-Q14) on ``events`` as a measurement frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.magnitude import add_magnitude
from hostlens.functions.timefmt import normalize_time_text
from hostlens.operators import series as S
from hostlens.registered.common import (SQL_BUILDING_HOSTS, SQL_MEASUREMENTS, building_hosts,
                                        measurements)
from hostlens.registry import r6, register, sql_ts, table, ts_text

M = SQL_MEASUREMENTS
RANGE_START = "2024-01-03 00:00:00"
RANGE_END = "2024-01-09 12:00:00"


def _numeric(spark, sf):
    return S.coerce_numeric(measurements(spark, sf), "Value")


@register("q1_host_filter", f"""
SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Hostname", "Series", "Value", pos FROM {M} m
WHERE "Hostname" IN {SQL_BUILDING_HOSTS}""")
def q1(spark, sf):
    df = S.select_hosts(_numeric(spark, sf), building_hosts(spark, sf))
    return df.withColumn("Timestamp", ts_text("Timestamp"))


@register("q2_equality_filter", f"""
SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Hostname", "Value" FROM {M} m WHERE "Series" = 'purchase'""")
def q2(spark, sf):
    df = S.filter_equals(measurements(spark, sf), "Series", "purchase")
    df = S.coerce_numeric(S.project(df, "Timestamp", "Hostname", "Value"), "Value")
    return df.withColumn("Timestamp", ts_text("Timestamp"))


@register("q3_projection", f"""
SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Series", "Value" FROM {M} m""")
def q3(spark, sf):
    df = S.coerce_numeric(S.project(measurements(spark, sf), "Timestamp", "Series", "Value"), "Value")
    return df.withColumn("Timestamp", ts_text("Timestamp"))


@register("q2_typed_filter", """
SELECT 'text as number' AS f, c_custkey FROM customer WHERE c_custkey = 17
UNION ALL SELECT 'number as text', c_custkey FROM customer WHERE c_name = '17'
UNION ALL SELECT 'number', c_custkey FROM customer WHERE c_nationkey = 3""")
def q2_typed(spark, sf):
    # a value that is none of the column's type equals nothing, and ends no job
    c = table(spark, sf, "customer")
    pick = lambda name, *dfs: [d.select(F.lit(name).alias("f"), "c_custkey") for d in dfs]
    parts = (pick("text as number", S.filter_equals(c, "c_custkey", "17"), S.filter_equals(c, "c_acctbal", "no number"))
             + pick("number as text", S.filter_equals(c, "c_name", 17))
             + pick("number", S.filter_equals(c, "c_nationkey", 3), S.filter_equals(c, "c_custkey", "2024-01-01")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("q4_numeric_coercion", """
SELECT event_id AS pos,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS "Value" FROM events""")
def q4(spark, sf):
    ev = table(spark, sf, "events")
    # text as a device log would hold it: padded numbers, and a word for failed reads
    txt = (F.when(F.col("event_type") == "error", F.lit("n/a"))
           .otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))))
    df = ev.select(F.col("event_id").alias("pos"), txt.alias("Value"))
    return S.coerce_numeric(df, "Value")


@register("q5_time_index", """
SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS "Hostname",
  CASE WHEN event_type = 'signup' THEN 'pending' ELSE strftime(ts, '%m/%d/%Y %H:%M:%S') END AS "Timestamp"
FROM events""")
def q5(spark, sf):
    ev = table(spark, sf, "events")
    raw = (F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(F.col("event_type") == "signup", F.lit("pending"))
           .otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss.SSS")))
    df = ev.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("Hostname"),
                   raw.alias("Timestamp"))
    return df.withColumn("Timestamp", normalize_time_text("Timestamp"))


@register("q6_time_range", f"""
SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Hostname", "Value" FROM {M} m
WHERE "Timestamp" BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'""")
def q6(spark, sf):
    df = S.time_range(S.time_index(_numeric(spark, sf), "Timestamp"), "Timestamp", RANGE_START, RANGE_END)
    return df.select(ts_text("Timestamp").alias("Timestamp"), "Hostname", "Value")


@register("q7_per_host_series", f"""
SELECT "Hostname", row_number() OVER (PARTITION BY "Hostname" ORDER BY "Timestamp", pos) - 1 AS x,
  {sql_ts('"Timestamp"')} AS "Timestamp", "Value" FROM {M} m WHERE "Hostname" IN {SQL_BUILDING_HOSTS}""")
def q7(spark, sf):
    df = S.select_hosts(_numeric(spark, sf), building_hosts(spark, sf))
    df = S.ordinal_x(df, "Hostname", ["Timestamp", "pos"])
    return df.select("Hostname", "x", ts_text("Timestamp").alias("Timestamp"), "Value")


def _sql_positional(k: int, select: str, order: str = '"Timestamp", pos',
                    part: str = 'PARTITION BY "Hostname"', keys: str = '"Hostname", ') -> str:
    return f"""
WITH r AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS rn FROM {M} m)
SELECT {keys}rn // {k} AS bucket, {select} FROM r GROUP BY {keys}rn // {k}"""


def _pos(interval, agg):
    def build(spark, sf):
        df = S.positional_buckets(_numeric(spark, sf), interval, agg)
        out = df.withColumn("Timestamp", ts_text("Timestamp"))
        if agg in ("mean", "average"):
            out = out.withColumn("Value", r6("Value"))
        return out
    return build


_ARG = lambda f: (f'{sql_ts(f"{f}(\"Timestamp\", rn)")} AS "Timestamp", {f}("Series", rn) AS "Series", '
                  f'{f}("Value", rn) AS "Value", {f}(pos, rn) AS pos')
_MM = lambda f: (f'{sql_ts(f"{f}(\"Timestamp\")")} AS "Timestamp", {f}("Series") AS "Series", '
                 f'{f}("Value") AS "Value", {f}(pos) AS pos')

register("q8a_last_30", _sql_positional(2, _ARG("arg_max")))(_pos(30, "last"))
register("q8a_first_30", _sql_positional(2, _ARG("arg_min")))(_pos(30, "first"))
register("q8b_min_60", _sql_positional(4, _MM("min")))(_pos(60, "min"))
register("q8b_max_60", _sql_positional(4, _MM("max")))(_pos(60, "MAX"))
register("q8c_mean_45", _sql_positional(
    3, f'{sql_ts("min(\"Timestamp\")")} AS "Timestamp", round(avg("Value"), 6) AS "Value"'))(_pos(45, "Average"))


@register("q8d_passthrough", f"""
SELECT {sql_ts('"Timestamp"')} AS "Timestamp", "Hostname", "Series", "Value", pos FROM {M} m""")
def q8d(spark, sf):
    # 20 is not a multiple of the sample period and 'median' is no known aggregation: rows pass
    df = S.positional_buckets(_numeric(spark, sf), 20, "last")
    df = S.positional_buckets(df, 30, "median")
    return df.withColumn("Timestamp", ts_text("Timestamp"))


@register("q8e_frame_last_30", f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS rn FROM {M} m)
SELECT rn // 2 AS bucket, {sql_ts('arg_max("Timestamp", rn)')} AS "Timestamp", arg_max("Hostname", rn) AS "Hostname",
  arg_max("Series", rn) AS "Series", arg_max("Value", rn) AS "Value", arg_max(pos, rn) AS pos
FROM r GROUP BY rn // 2""")
def q8e(spark, sf):
    df = S.frame_buckets(_numeric(spark, sf), 30, "last")
    return df.withColumn("Timestamp", ts_text("Timestamp"))


def _sql_bucket(sec: int) -> str:
    return f"make_timestamp(epoch_us(\"Timestamp\") // {sec * 1_000_000} * {sec * 1_000_000})"


@register("q9a_time_bucket_mean_300", f"""
SELECT "Hostname", {sql_ts(_sql_bucket(300))} AS bucket_start, {sql_ts('min("Timestamp")')} AS "Timestamp",
  round(avg("Value"), 6) AS "Value" FROM {M} m GROUP BY "Hostname", {_sql_bucket(300)}""")
def q9a(spark, sf):
    df = S.time_buckets(_numeric(spark, sf), 300, "mean")
    return df.select("Hostname", ts_text("bucket_start").alias("bucket_start"),
                     ts_text("Timestamp").alias("Timestamp"), r6("Value").alias("Value"))


@register("q9b_time_bucket_last_3600", f"""
SELECT "Hostname", {sql_ts(_sql_bucket(3600))} AS bucket_start,
  {sql_ts('arg_max("Timestamp", ("Timestamp", pos))')} AS "Timestamp",
  arg_max("Series", ("Timestamp", pos)) AS "Series", arg_max("Value", ("Timestamp", pos)) AS "Value",
  arg_max(pos, ("Timestamp", pos)) AS pos
FROM {M} m GROUP BY "Hostname", {_sql_bucket(3600)}""")
def q9b(spark, sf):
    df = S.time_buckets(_numeric(spark, sf), 3600, "last")
    return (df.withColumn("bucket_start", ts_text("bucket_start"))
            .withColumn("Timestamp", ts_text("Timestamp")))


@register("q9c_time_bucket_stats_86400", f"""
SELECT "Hostname", {sql_ts(_sql_bucket(86400))} AS bucket_start, count(*) AS n,
  min("Value") AS min_value, max("Value") AS max_value, round(avg("Value"), 6) AS mean_value,
  arg_min("Value", ("Timestamp", pos)) AS first_value, arg_max("Value", ("Timestamp", pos)) AS last_value
FROM {M} m GROUP BY "Hostname", {_sql_bucket(86400)}""")
def q9c(spark, sf):
    df = S.time_bucket_stats(_numeric(spark, sf), 86400)
    return (df.withColumn("bucket_start", ts_text("bucket_start"))
            .withColumn("mean_value", r6("mean_value")))


@register("q10_grouped_series", f"""
WITH b AS (SELECT "Series", {_sql_bucket(3600)} AS bs, min("Timestamp") AS t, avg("Value") AS v
           FROM {M} m GROUP BY "Series", {_sql_bucket(3600)})
SELECT "Series", {sql_ts('bs')} AS bucket_start, {sql_ts('t')} AS "Timestamp", round(v, 6) AS "Value",
  row_number() OVER (PARTITION BY "Series" ORDER BY bs) - 1 AS x FROM b""")
def q10(spark, sf):
    df = S.grouped_series(_numeric(spark, sf), "Series", 3600, "mean")
    return df.select("Series", ts_text("bucket_start").alias("bucket_start"),
                     ts_text("Timestamp").alias("Timestamp"), r6("Value").alias("Value"), "x")


#: The event types of the generated tables; the query itself asks the data, so a new type gets its column.
SERIES_VALUES = ["click", "error", "purchase", "signup", "view"]


@register("q11_pivot_by_day", "SELECT strftime(date_trunc('day', \"Timestamp\"), '%Y-%m-%d') AS row_key, " + ", ".join(
    f"round(avg(\"Value\") FILTER (WHERE \"Series\" = '{v}'), 6) AS {v}" for v in SERIES_VALUES)
    + f" FROM {M} m GROUP BY 1")
def q11(spark, sf):
    df = _numeric(spark, sf)
    values = S.pivot_values(df, "Series")
    wide = S.pivot_wide(df, F.date_format("Timestamp", "yyyy-MM-dd"), "Series", values, "Value", agg="avg")
    return wide.select("row_key", *[r6(v).alias(v) for v in values])


@register("q11_pivot_left_first", f"""
WITH h AS (SELECT date_trunc('hour', "Timestamp") AS t, "Series", "Value", pos FROM {M} m),
f AS (SELECT t, "Series", arg_min("Value", pos) AS v FROM h GROUP BY 1, 2)
SELECT strftime(a.t, '%Y-%m-%d %H') AS row_key, a.v AS error, b.v AS signup FROM f a LEFT JOIN f b ON a.t = b.t AND b."Series" = 'signup'
WHERE a."Series" = 'error'""")
def q11l(spark, sf):
    return S.pivot_left(_numeric(spark, sf), F.date_format("Timestamp", "yyyy-MM-dd HH"), "Series", ["error", "signup"], "Value")


@register("q10_grouped_positional", f"""
WITH r AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 3 AS bucket FROM {M} m),
b AS (SELECT bucket, arg_min("Series", pos) AS "Series", min("Timestamp") AS t, avg("Value") AS v FROM r GROUP BY bucket)
SELECT bucket, "Series", {sql_ts('t')} AS "Timestamp", round(v, 6) AS "Value", row_number() OVER (PARTITION BY "Series" ORDER BY bucket) - 1 AS x FROM b""")
def q10p(spark, sf):
    df = S.grouped_series(_numeric(spark, sf), "Series", 45, "mean", positional=True)
    return df.select("bucket", "Series", ts_text("Timestamp").alias("Timestamp"), r6("Value").alias("Value"), "x")


@register("q12_ordinal_x", f"""
SELECT "Hostname", row_number() OVER (PARTITION BY "Hostname" ORDER BY "Timestamp", pos) - 1 AS x,
  "Value" FROM {M} m""")
def q12(spark, sf):
    df = S.ordinal_x(_numeric(spark, sf), "Hostname", ["Timestamp", "pos"])
    return df.select("Hostname", "x", "Value")


@register("q13_hour_ticks", f"""
WITH s AS (SELECT "Hostname", min("Timestamp") AS st, max("Timestamp") AS en FROM {M} m GROUP BY 1),
h AS (SELECT *, CAST(floor((epoch_us(en) - epoch_us(st)) / 3600000000) AS INTEGER) AS hours FROM s)
SELECT "Hostname", {sql_ts('st')} AS start, unnest(generate_series(0, hours, greatest(CAST(ceil((hours + 1) / 24.0) AS INTEGER), 1))) AS tick_hour
FROM h""")
def q13(spark, sf):
    df = S.hour_ticks(measurements(spark, sf), max_labels=24)
    return df.withColumn("start", ts_text("start"))


def _sql_magnitude(x: str, base: int, three_digit: bool) -> str:
    """The Q14 formula in DuckDB SQL, over an integer expression ``x``."""
    ax = f"abs(CAST({x} AS HUGEINT))"
    mag = (f"CAST(floor(ln(abs({x})) / ln(10.24)) AS INTEGER)" if base == 1024
           else f"(length(CAST({ax} AS VARCHAR)) - 1)")
    if three_digit:
        ill = f"({mag} // 3)"
        places = f"(CASE WHEN {mag} % 3 = 0 THEN 2 ELSE 1 END)"
    else:
        ill = f"(({mag} + 1) // 3)"
        places = f"(CASE WHEN {mag} % 3 = 1 THEN 1 ELSE 2 END)"
    den = f"CAST(pow({base}, {ill}) AS HUGEINT)"
    # printf rounds the binary double correctly, as C / Python formatting does
    fixed = (f"(CASE WHEN {places} = 1 THEN printf('%.1f', CAST({ax} AS DOUBLE) / CAST({den} AS DOUBLE)) "
             f"ELSE printf('%.2f', CAST({ax} AS DOUBLE) / CAST({den} AS DOUBLE)) END)")
    suffix = f"(['', 'K', 'M', 'G', 'T', 'P'])[{ill} + 1]"
    sign = f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END)"
    big = f"({sign} || CAST({ax} // CAST(pow({base}, 5) AS HUGEINT) AS VARCHAR) || 'P')"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0' WHEN {mag} > 16 THEN {big} "
            f"ELSE {sign} || {fixed} || {suffix} END)")


_CENTS = "CAST(trunc(o_totalprice * 100) AS BIGINT)"


@register("q14_magnitude", f"""
SELECT o_orderkey, {_CENTS} AS cents, {_sql_magnitude(_CENTS, 1000, False)} AS m1000,
  {_sql_magnitude(_CENTS, 1024, False)} AS m1024, {_sql_magnitude(_CENTS, 1000, True)} AS m1000_3,
  {_sql_magnitude('o_custkey - 700', 1000, False)} AS m_small FROM orders""")
def q14(spark, sf):
    o = table(spark, sf, "orders")
    df = o.select("o_orderkey", (F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
                  (F.col("o_custkey") - 700).alias("_small"))
    df = add_magnitude(df, "cents", "m1000", 1000)
    df = add_magnitude(df, "cents", "m1024", 1024)
    df = add_magnitude(df, "cents", "m1000_3", 1000, three_digit=True)
    df = add_magnitude(df, "_small", "m_small", 1000)
    return df.drop("_small")


def _saved_specs(spark, sf):
    """One saved chart per series value: options JSON as a chart page stores it;
    click and view charts chose the max, the others the last row of each hour."""
    ev = table(spark, sf, "events")
    et = ev.select("event_type").distinct()
    agg = F.when(F.col("event_type").isin("click", "view"), F.lit("MAX")).otherwise(F.lit("last"))
    opts = F.to_json(F.create_map(F.lit("filter"), F.col("event_type"), F.lit("aggregation"), agg, F.lit("interval"), F.lit("3600"),
                                  F.lit("bucket"), F.lit("time"), F.lit("title"), F.lit("ignored")))
    return et.select(F.col("event_type").alias("spec_id"), opts.alias("options"))


@register("q15_saved_specs", f"""
SELECT "Series" AS spec_id, "Hostname", CAST(epoch_us("Timestamp") // 3600000000 * 3600 AS BIGINT) AS bucket,
  CASE WHEN "Series" IN ('click', 'view') THEN max("Value") ELSE arg_max("Value", ("Timestamp", pos)) END AS "Value"
FROM {M} m GROUP BY "Series", "Hostname", epoch_us("Timestamp") // 3600000000""")
def q15(spark, sf):
    from hostlens.operators.specs import run_specs
    return run_specs(_numeric(spark, sf), _saved_specs(spark, sf)).drop("Timestamp")


def _spec(spark, *options: str):
    return spark.range(len(options)).select(F.col("id").alias("spec_id"), F.element_at(F.array(*[F.lit(o) for o in options]), F.col("id").cast("int") + 1).alias("options"))


def _run(spark, sf, *options: str):
    from hostlens.operators.specs import run_specs
    return run_specs(_numeric(spark, sf), _spec(spark, *options)).withColumn("Timestamp", ts_text("Timestamp"))


@register("q15_no_filter", f"""
WITH r AS (SELECT *, (row_number() OVER (PARTITION BY "Hostname" ORDER BY "Timestamp", pos) - 1) // 4 AS bucket FROM {M} m)
SELECT 0::BIGINT AS spec_id, "Hostname", bucket, {sql_ts('min("Timestamp")')} AS "Timestamp", round(avg("Value"), 6) AS "Value"
FROM r GROUP BY "Hostname", bucket""")
def q15n(spark, sf):
    return _run(spark, sf, '{"interval": "60", "aggregation": "average", "filter": null}').withColumn("Value", r6("Value"))


@register("q15_host_list", f"""
SELECT 0::BIGINT AS spec_id, "Hostname", NULL::BIGINT AS bucket, {sql_ts('"Timestamp"')} AS "Timestamp", "Value" FROM {M} m WHERE "Hostname" IN ('3', '14', '77')
UNION ALL SELECT 1, "Hostname", NULL, {sql_ts('"Timestamp"')}, "Value" FROM {M} m WHERE "Hostname" = '3' AND "Series" = 'view'""")
def q15h(spark, sf):
    return _run(spark, sf, '{"hostnames": ["3", "14", "77", "3"], "interval": "", "aggregation": ""}', '{"hostnames": "3", "filter": "view"}')


@register("q15_time_range", f"""
SELECT 0::BIGINT AS spec_id, "Hostname", NULL::BIGINT AS bucket, {sql_ts('"Timestamp"')} AS "Timestamp", "Value" FROM {M} m
WHERE "Timestamp" BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}' AND "Series" = 'error'
UNION ALL SELECT 1, "Hostname", NULL, {sql_ts('"Timestamp"')}, "Value" FROM {M} m WHERE "Timestamp" <= TIMESTAMP '{RANGE_START}'""")
def q15t(spark, sf):
    return _run(spark, sf, f'{{"start_time": "{RANGE_START}", "end_time": "{RANGE_END}", "filter": "error"}}', f'{{"end_time": "{RANGE_START}"}}')


@register("q15_many_specs", f"""
SELECT c_custkey AS spec_id, "Hostname", NULL::BIGINT AS bucket, {sql_ts('"Timestamp"')} AS "Timestamp", "Value"
FROM {M} m JOIN customer ON "Hostname" = CAST(c_custkey % 40 AS VARCHAR)
 AND "Timestamp" BETWEEN TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 20 MINUTE AND TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 20 MINUTE + (c_custkey % 7) * INTERVAL 5 HOUR""")
def q15_many(spark, sf):
    # a spec per customer, each of one host and some hours: joined as a table, by bins of time
    from hostlens.operators.specs import run_specs
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("c_custkey") * 20).cast("int"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    specs = table(spark, sf, "customer").select(F.col("c_custkey").alias("spec_id"), F.to_json(F.struct(
        (F.col("c_custkey") % 40).cast("string").alias("hostnames"), text(at).alias("start_time"),
        text(at + F.make_dt_interval(hours=((F.col("c_custkey") % 7) * 5).cast("int"))).alias("end_time"))).alias("options"))
    out = run_specs(_numeric(spark, sf), specs, max_specs=100)
    return out.withColumn("Timestamp", ts_text("Timestamp"))


@register("q15_bad_interval", f"""
SELECT s AS spec_id, "Hostname", NULL::BIGINT AS bucket, {sql_ts('"Timestamp"')} AS "Timestamp", "Value"
FROM {M} m, (SELECT unnest([0, 1, 2, 3])::BIGINT AS s) WHERE "Series" = 'signup'""")
def q15b(spark, sf):
    return _run(spark, sf, '{"interval": "0", "aggregation": "last", "bucket": "time", "filter": "signup"}',
                '{"interval": "soon", "aggregation": "last", "filter": "signup"}', '{"interval": "20", "aggregation": "last", "filter": "signup"}',
                '{"interval": "30", "aggregation": "median", "filter": "signup"}')


@register("q5_text_index", f"""
SELECT event_id AS pos, {sql_ts("date_trunc('second', ts)")} AS "Timestamp" FROM events""")
def q5t(spark, sf):
    text = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss.SSS").alias("Timestamp"))
    return S.time_index(text, "Timestamp").withColumn("Timestamp", ts_text("Timestamp"))


def _sql_chart_magnitude(x: str) -> str:
    return _sql_magnitude(x, 1024, False).replace("pow(1024", "pow(1000")


@register("q14_chart_magnitude", f"SELECT o_orderkey, {_sql_chart_magnitude(_CENTS)} AS m FROM orders")
def q14c(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return add_magnitude(o, "cents", "m", chart=True).select("o_orderkey", "m")
