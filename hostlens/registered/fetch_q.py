"""Registered lookup-joined fetch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators.scan import ordinal
from hostlens.plans.fetch_spec import (FetchSpec, Lookup, catalogue, chart_list, fetch, json_ids, key_filter, list_bad_members,
                                       list_ids, nest_dotted, options, role_options, side_options)
from hostlens.registry import register, table


def _t(spark, sf, *names):
    return {n: table(spark, sf, n) for n in names}


NATION = Lookup("nation", fk="c_nationkey", fields=("n_name", "n_regionkey"), key="n_nationkey")
CUSTOMERS = FetchSpec("customer", "c_custkey", ("c_name", "c_acctbal"), (NATION,), scope_col="c_nationkey")


def _flat(df, *structs):
    return df.select("DT_RowId", *[f"{s}.*" for s in structs])


@register("t2_key_filter", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def t2(spark, sf):
    keys = table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey")
    return key_filter(table(spark, sf, "orders"), "o_custkey", keys).select("o_orderkey", "o_custkey", "o_totalprice")


@register("t3_scope_filter", """
SELECT CAST(c_custkey AS VARCHAR) AS "DT_RowId", c_custkey, c_name, c_acctbal, n_name, n_regionkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 7""")
def t3(spark, sf):
    return _flat(fetch(CUSTOMERS, _t(spark, sf, "customer", "nation"), scope=7), "main", "nation")


@register("t5_single_lookup", """
SELECT CAST(c_custkey AS VARCHAR) AS "DT_RowId", c_custkey, c_name, c_acctbal, n_name, n_regionkey
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def t5(spark, sf):
    return _flat(fetch(CUSTOMERS, _t(spark, sf, "customer", "nation")), "main", "nation")


@register("t9_order_limit", """
SELECT CAST(c_custkey AS VARCHAR) AS "DT_RowId", c_custkey, c_name, c_acctbal, n_name, n_regionkey
FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 15""")
def t9(spark, sf):
    spec = FetchSpec("customer", "c_custkey", ("c_name", "c_acctbal"),
                     (Lookup("nation", fk="c_nationkey", fields=("n_name", "n_regionkey"), key="n_nationkey",
                             how="inner"),),
                     order=(("c_acctbal", "desc"),), limit=15)
    return _flat(fetch(spec, _t(spark, sf, "customer", "nation")), "main", "nation")


def _orders_with_part_lists(spark, sf):
    """each order with the comma list of its line items' part keys."""
    li = table(spark, sf, "lineitem")
    lists = li.groupBy("l_orderkey").agg(
        F.concat_ws(",", F.collect_list(F.col("l_partkey").cast("string"))).alias("fk_part_list"))
    return table(spark, sf, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")


PARTS = Lookup("part", fk="fk_part_list", label=("p_name", "p_brand"), key="p_partkey", kind="list")

_SQL_LISTS = """
WITH lists AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',') AS fk_part_list FROM lineitem GROUP BY 1),
m AS (SELECT o.o_orderkey, o.o_orderstatus, l.fk_part_list FROM orders o LEFT JOIN lists l ON o.o_orderkey = l.l_orderkey)"""


@register("t6_list_lookup", _SQL_LISTS + """,
ex AS (SELECT o_orderkey, TRY_CAST(trim(u) AS BIGINT) AS v FROM m, unnest(string_split(fk_part_list, ',')) AS t(u)),
pairs AS (SELECT DISTINCT ex.o_orderkey, ex.v, p.p_name || ' ' || p.p_brand AS label
          FROM ex JOIN part p ON p.p_partkey = ex.v),
agg AS (SELECT o_orderkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY label, v) AS part_values,
               string_agg(label, '|' ORDER BY label, v) AS part_labels, count(*) AS n_parts FROM pairs GROUP BY 1)
SELECT CAST(m.o_orderkey AS VARCHAR) AS "DT_RowId", m.o_orderkey, m.o_orderstatus,
  coalesce(agg.part_values, '') AS part_values, coalesce(agg.part_labels, '') AS part_labels,
  coalesce(agg.n_parts, 0) AS n_parts
FROM m LEFT JOIN agg USING (o_orderkey)""")
def t6(spark, sf):
    spec = FetchSpec("orders", "o_orderkey", ("o_orderstatus",), (PARTS,))
    tabs = {"orders": _orders_with_part_lists(spark, sf), "part": table(spark, sf, "part")}
    out = fetch(spec, tabs)
    return out.select("DT_RowId", "main.o_orderkey", "main.o_orderstatus",
                      F.array_join(F.transform("part", lambda e: e["value"].cast("string")), ",").alias("part_values"),
                      F.array_join(F.transform("part", lambda e: e["label"]), "|").alias("part_labels"),
                      F.size("part").cast("bigint").alias("n_parts"))


@register("t12_list_parse", _SQL_LISTS + """,
t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN fk_part_list || ', n/a,' ELSE fk_part_list END AS txt FROM m),
u AS (SELECT o_orderkey, trim(x) AS x FROM t, unnest(string_split(txt, ',')) AS s(x) WHERE trim(x) <> '')
SELECT t.o_orderkey, coalesce(sum(CASE WHEN TRY_CAST(u.x AS BIGINT) IS NOT NULL THEN 1 ELSE 0 END), 0) AS n_ids,
  coalesce(sum(CASE WHEN TRY_CAST(u.x AS BIGINT) IS NULL AND u.x IS NOT NULL THEN 1 ELSE 0 END), 0) AS n_bad
FROM t LEFT JOIN u USING (o_orderkey) GROUP BY t.o_orderkey""")
def t12(spark, sf):
    m = _orders_with_part_lists(spark, sf)
    txt = F.when(F.col("o_orderstatus") == "P", F.concat(F.col("fk_part_list"), F.lit(", n/a,"))) \
        .otherwise(F.col("fk_part_list"))
    return m.select("o_orderkey", F.size(list_ids(txt)).cast("bigint").alias("n_ids"),
                    F.size(list_bad_members(txt)).cast("bigint").alias("n_bad"))


@register("t13_json_props", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def t13(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("t15_option_lists", """
WITH o AS (
  SELECT DISTINCT 'c_nationkey' AS field, n_name AS label, CAST(n_nationkey AS BIGINT) AS value FROM nation
  UNION ALL SELECT DISTINCT 'n_regionkey', r_name, CAST(r_regionkey AS BIGINT) FROM region
  UNION ALL SELECT DISTINCT 'l_partkey', p_name || ' ' || p_brand, p_partkey FROM part)
SELECT field, label, value, row_number() OVER (PARTITION BY field ORDER BY label, value) - 1 AS rank FROM o""")
def t15(spark, sf):
    opts = options([("c_nationkey", table(spark, sf, "nation"), ["n_name"], "n_nationkey"),
                    ("n_regionkey", table(spark, sf, "region"), ["r_name"], "r_regionkey"),
                    ("l_partkey", table(spark, sf, "part"), ["p_name", "p_brand"], "p_partkey")])
    return ordinal(opts, "field", [F.col("label"), F.col("value")], name="rank")


@register("t16_scoped_options", """
SELECT 'o_custkey' AS field, c_name AS label, c_custkey AS value FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'c_nationkey', n_name, CAST(n_nationkey AS BIGINT) FROM nation""")
def t16(spark, sf):
    cust = options([("o_custkey", table(spark, sf, "customer"), ["c_name"], "c_custkey")],
                   scope_col="c_nationkey", scope=7)
    nat = options([("c_nationkey", table(spark, sf, "nation"), ["n_name"], "n_nationkey")],
                  scope_col="c_nationkey", scope=7)      # nation has no scope column: all rows
    return cust.unionByName(nat)


def _types(spark, sf):
    """F6 types derived from nation: type text ends in Pub/Sub, object type Cucm/Ucce."""
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("pkid"),
                    F.concat(F.col("n_name"), F.lit(" "),
                             F.when(F.col("n_regionkey") <= 1, F.lit("Pub")).otherwise(F.lit("Sub"))).alias("type"),
                    F.when(F.col("n_nationkey") < 15, F.lit("Cucm")).otherwise(F.lit("Ucce")).alias("object_type"))


def _hosts(spark, sf):
    s = table(spark, sf, "supplier")
    suffix = F.when(F.col("s_acctbal") > 5000, F.lit("A")).when(F.col("s_acctbal") < 1000, F.lit("b")).otherwise(F.lit(""))
    return s.select(F.col("s_suppkey").alias("pkid"), F.concat(F.col("s_name"), suffix).alias("hostname"),
                    F.col("s_nationkey").alias("fk_types"))


_SQL_TYPES = """
WITH types AS (SELECT n_nationkey AS pkid, n_name || ' ' || CASE WHEN n_regionkey <= 1 THEN 'Pub' ELSE 'Sub' END AS type,
                      CASE WHEN n_nationkey < 15 THEN 'Cucm' ELSE 'Ucce' END AS object_type FROM nation),
hosts AS (SELECT s_suppkey AS pkid, s_name || CASE WHEN s_acctbal > 5000 THEN 'A' WHEN s_acctbal < 1000 THEN 'b' ELSE '' END AS hostname,
                 s_nationkey AS fk_types FROM supplier)"""


@register("t17_role_options", _SQL_TYPES + """
SELECT string_split(t.type, ' ')[-1] AS role, string_split(t.type, ' ')[-1] <> 'Pub' AS multi,
  h.pkid AS value, h.hostname AS label
FROM hosts h JOIN types t ON h.fk_types = t.pkid WHERE t.object_type = 'Cucm'""")
def t17(spark, sf):
    return role_options(_hosts(spark, sf), _types(spark, sf))


@register("t18_side_options", _SQL_TYPES + """
SELECT side, h.pkid AS value, h.hostname AS label
FROM hosts h JOIN types t ON h.fk_types = t.pkid,
  unnest(CASE WHEN lower(h.hostname) LIKE '%a' THEN ['a'] WHEN lower(h.hostname) LIKE '%b' THEN ['b']
              ELSE ['a', 'b'] END) AS s(side)
WHERE t.object_type = 'Ucce'""")
def t18(spark, sf):
    return side_options(_hosts(spark, sf), _types(spark, sf))


@register("t20_chart_list", """
SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def t20(spark, sf):
    spec = chart_list("orders", "o_orderkey", ("o_totalprice",), [
        ("customer", "o_custkey", "c_custkey", ("c_name",)), ("nation", "customer.c_nationkey", "n_nationkey", ("n_name",)),
        ("region", "nation.n_regionkey", "r_regionkey", ("r_name",))])
    out = fetch(spec, _t(spark, sf, "orders", "customer", "nation", "region"))
    return out.select("main.o_orderkey", "customer.c_name", "nation.n_name", "region.r_name", "main.o_totalprice")


# The two chart sources the catalogue is seeded with.
GRAPH_SOURCES = [(1, "fk_textfsm", "Text File"), (2, "fk_perfmon_counters", "Perfmon CSV")]


@register("t19_catalogue", """
WITH c AS (SELECT o.o_orderkey, CASE WHEN o.o_orderstatus = 'F' THEN 'fk_textfsm' ELSE 'fk_perfmon_counters' END AS field,
                  n.n_nationkey, n.n_name, r.r_name
           FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN nation n ON cu.c_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey),
f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT c.o_orderkey AS chart_id, p.p_partkey AS upload_id, p.p_name AS upload_name, c.field AS source_field,
  CASE WHEN c.field = 'fk_textfsm' THEN 'Value ' || lower(c.r_name) || ' (\\S+)' ELSE c.n_name || '\\% Processor Time' END AS filter_data
FROM c JOIN f ON f.l_orderkey = c.o_orderkey JOIN part p ON p.p_partkey = f.l_partkey""")
def t19(spark, sf):
    o, li, cu, n, r, p = (table(spark, sf, x) for x in ("orders", "lineitem", "customer", "nation", "region", "part"))
    # F4 catalogue derived from the tables: a chart per order, its file set as JSON ids (the parts of its
    # lines), its source by status, templates per region, counters per nation
    files = li.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set(
        F.struct(F.col("l_partkey").cast("string").alias("id"))))).alias("uploaded_files"))
    charts = (o.join(cu, o.o_custkey == cu.c_custkey).join(n, cu.c_nationkey == n.n_nationkey)
              .join(files, o.o_orderkey == files.l_orderkey, "left")
              .select(F.col("o_orderkey").alias("pkid"), "uploaded_files",
                      F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("fk_graph_sources"),
                      F.col("n_regionkey").alias("fk_textfsm"), F.col("n_nationkey").alias("fk_perfmon_counters")))
    sources = spark.createDataFrame(GRAPH_SOURCES, "pkid int, field string, title string")
    templates = r.select(F.col("r_regionkey").alias("pkid"), F.concat(F.lit("Value "), F.lower("r_name"), F.lit(" (\\S+)")).alias("script"))
    counters = n.select(F.col("n_nationkey").alias("pkid"), F.concat("n_name", F.lit("\\% Processor Time")).alias("name"))
    uploads = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"))
    return catalogue(charts, uploads, sources, templates, counters)


@register("t13_json_ids", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE coalesce(n, 0) END AS n_ids, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE coalesce(s, 0) END AS sum_ids
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS s
                       FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def t13_ids(spark, sf):
    files = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set(
        F.struct(F.col("l_partkey").cast("string").alias("id")))).alias("j"))
    o = table(spark, sf, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ids = json_ids(F.when(F.col("o_orderstatus") == "P", F.lit("no json")).otherwise(F.col("j")))
    return o.select("o_orderkey", F.size(ids).cast("bigint").alias("n_ids"),
                    F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x["id"]).alias("sum_ids"))


@register("t14_nested_names", "SELECT o_orderkey, o_orderstatus, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def t14(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    dotted = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderstatus").alias("main.status"), F.col("c_name").alias("customer.name"), F.col("c_acctbal").alias("customer.bal"))
    nested = nest_dotted(dotted)
    return nested.select("o_orderkey", F.col("main.status").alias("o_orderstatus"), F.col("customer.name").alias("c_name"),
                         F.col("customer.bal").alias("c_acctbal"))
