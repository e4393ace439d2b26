"""Registered ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators.ordering import OrderedPages, filtered_counts, natural_rank, page
from hostlens.registry import register, table
from hostlens.session import scratch_path


def _sql_natkey(x: str) -> str:
    return (f"list_transform(regexp_extract_all(trim(coalesce({x}, '')), '(\\d+|\\D+)'), "
            "lambda c: {'t': NOT regexp_matches(c, '^\\d'), "
            "'l': CASE WHEN regexp_matches(c, '^\\d') THEN length(regexp_replace(c, '^0+', '')) ELSE 0 END, "
            "'d': CASE WHEN regexp_matches(c, '^\\d') THEN regexp_replace(c, '^0+', '') ELSE '' END, 'r': c})")


def _sql_rank(table_: str, x: str, tie: str, pre: str = "") -> str:
    key = _sql_natkey(pre or x)
    return (f"SELECT {tie}, {x}, row_number() OVER (ORDER BY {key}, {x}, {tie}) - 1 AS rank FROM {table_}")


@register("o1_natural_sort_names", _sql_rank("customer", "c_name", "c_custkey"))
def o1(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return natural_rank(c, "c_name", "c_custkey")


@register("o1_natural_sort_urls", _sql_rank("pages", "url", "page_id"))
def o1u(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return natural_rank(p, "url", "page_id")


@register("o1_natural_sort_numbers", """
SELECT event_id, v, row_number() OVER (ORDER BY CAST(v AS DOUBLE), v, event_id) - 1 AS rank
FROM (SELECT event_id, printf('%.2f', value - 50) AS v FROM events) WHERE v <> '-0.00'""")
def o1n(spark, sf):
    # signed decimals, ordered by the number they are
    v = F.format_string("%.2f", F.col("value") - 50)
    return natural_rank(table(spark, sf, "events").select("event_id", v.alias("v")).where("v <> '-0.00'"), "v", "event_id")


@register("o2_natural_nohtml", """
SELECT page_id, row_number() OVER (ORDER BY """ + _sql_natkey("regexp_replace(html, '<[^>]+>', '', 'g')")
          + """, html, page_id) - 1 AS rank FROM pages""")
def o2(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    return natural_rank(p, "html", "page_id", strip_html=True).select("page_id", "rank")


@register("o3_natural_ci", _sql_rank("pages", "url", "page_id", pre="lower(url)"))
def o3(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return natural_rank(p, "url", "page_id", case_insensitive=True)


@register("o4_page", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey
LIMIT 10 OFFSET 20""")
def o4(spark, sf):
    c = table(spark, sf, "customer")
    return page(c, [F.col("c_mktsegment"), F.col("c_acctbal").desc()], "c_custkey", 20, 10) \
        .select("c_custkey", "c_name", "c_acctbal")


@register("o4_deep_page", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS position FROM orders
QUALIFY position >= (SELECT count(*) // 2 FROM orders) AND position < (SELECT count(*) // 2 FROM orders) + 50""")
def o4_deep(spark, sf):
    # a page in the middle of the order, through the directory of its slices
    o = table(spark, sf, "orders")
    pages = OrderedPages.store(o, [F.col("o_orderstatus"), F.col("o_totalprice").desc()], "o_orderkey", scratch_path(spark, "ordered"))
    return pages.page(o.count() // 2, 50).select("o_orderkey", "o_totalprice", "position")


@register("o5_filtered_count", """
SELECT count(*) AS n_total, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS n_shown,
  count(*) - count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS n_filtered_out FROM customer""")
def o5(spark, sf):
    return filtered_counts(table(spark, sf, "customer"), F.col("c_mktsegment") == "AUTOMOBILE")


@register("o6_per_host_files", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)
SELECT 'series-' || CAST(user_id AS VARCHAR) AS file_name, rn // 2 AS bucket, arg_max(value, rn) AS "Value"
FROM r GROUP BY user_id, rn // 2""")
def o6(spark, sf):
    from hostlens.operators import series as S
    from hostlens.registered.common import measurements
    from hostlens.session import scratch_path
    from hostlens.sources.sinks import write_per_host
    df = S.positional_buckets(S.coerce_numeric(measurements(spark, sf), "Value"), 30, "last")
    out = write_per_host(df.select("Hostname", "bucket", "Value"), scratch_path(spark, "per-host"),
                         template="series-{hostname}")
    back = spark.read.option("basePath", out).parquet(out)
    return back.select(F.col("file_name").cast("string").alias("file_name"), "bucket", "Value")


@register("o7_json_rows", """
SELECT json_object('o_orderkey', o_orderkey, 'o_orderdate', strftime(o_orderdate, '%m-%d-%Y %H:%M:%S'),
  'o_totalprice', o_totalprice, 'o_orderstatus', o_orderstatus)::VARCHAR AS json FROM orders""")
def o7(spark, sf):
    from hostlens.sources.sinks import json_rows
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return json_rows(o)


@register("o8_export_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def o8(spark, sf):
    from hostlens.session import scratch_path
    from hostlens.sources.sinks import export_csv
    c = table(spark, sf, "customer")
    out = export_csv(c, scratch_path(spark, "export"))
    return spark.read.schema(c.schema).option("header", True).csv(out)
