"""Registered relational-layer queries (R1-R14) on the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.plans.query_spec import JoinSpec, QuerySpec, column_values, first_row, raw_sql
from hostlens.registry import r6, register, table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _tables(spark, sf, names=NAMES):
    return {n: table(spark, sf, n) for n in names}


@register("r1_select_expr", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS revenue,
  upper(l_returnflag) || l_linestatus AS flags FROM lineitem""")
def r1(spark, sf):
    spec = QuerySpec("lineitem", select=["l_orderkey", "l_linenumber",
                                         "round(l_extendedprice * (1 - l_discount), 6) AS revenue",
                                         "concat(upper(l_returnflag), l_linestatus) AS flags"])
    return spec.apply(_tables(spark, sf))


@register("r3_join_inner", """
SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def r3i(spark, sf):
    spec = QuerySpec("orders", "o", select=["o.o_orderkey", "c.c_name", "o.o_totalprice"],
                     joins=[JoinSpec("customer", "c", "o.o_custkey", "=", "c_custkey")])
    return spec.apply(_tables(spark, sf))


@register("r3_join_left", """
SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey""")
def r3l(spark, sf):
    spec = QuerySpec("customer", "c", select=["c.c_custkey", "o.o_orderkey"],
                     joins=[JoinSpec("orders", "o", "c.c_custkey", "=", "o_custkey", "left")])
    return spec.apply(_tables(spark, sf))


@register("r3_join_theta", """
SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey""")
def r3t(spark, sf):
    # theta join on two small dimension tables (nested loop is the right plan here)
    spec = QuerySpec("nation", "n", select=["n.n_name", "r.r_name"],
                     joins=[JoinSpec("region", "r", "n.n_regionkey", "<", "r_regionkey", max_rows=5)])
    return spec.apply(_tables(spark, sf, ("nation", "region")))


@register("r4_where", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'""")
def r4(spark, sf):
    spec = QuerySpec("lineitem", select=["l_orderkey", "l_linenumber", "l_quantity"],
                     where="l_quantity > 45 AND l_returnflag = 'R'")
    return spec.apply(_tables(spark, sf, ("lineitem",)))


@register("r4_where_params", """
SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_linestatus <> ':x'""")
def r4p(spark, sf):
    spec = QuerySpec("lineitem", "l", select=["l.l_orderkey", "l.l_linenumber", "l.l_quantity * :times AS q"],
                     where="l.l_quantity > :least AND l.l_returnflag = :flag AND l.l_linestatus <> ':x'",
                     params={"least": 45, "flag": "R", "times": 2})
    return spec.apply(_tables(spark, sf, ("lineitem",)))


@register("r5_group_by", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty,
  round(sum(l_extendedprice), 6) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 6) AS sum_disc_price,
  round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def r5(spark, sf):
    spec = QuerySpec("lineitem", group_by=["l_returnflag", "l_linestatus"],
                     aggregates=["round(sum(l_quantity), 6) AS sum_qty",
                                 "round(sum(l_extendedprice), 6) AS sum_base_price",
                                 "round(sum(l_extendedprice * (1 - l_discount)), 6) AS sum_disc_price",
                                 "round(avg(l_quantity), 6) AS avg_qty", "count(*) AS count_order"])
    return spec.apply(_tables(spark, sf, ("lineitem",)))


@register("r6_order_limit", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def r6_(spark, sf):
    spec = QuerySpec("orders", select=["o_orderkey", "o_totalprice"],
                     order_by=[("o_totalprice", "desc"), ("o_orderkey", "asc")], limit=10)
    return spec.apply(_tables(spark, sf, ("orders",)))


@register("r7_group_having_order", """
SELECT c_nationkey, count(*) AS n_customers, round(avg(c_acctbal), 6) AS avg_bal FROM customer
GROUP BY c_nationkey HAVING count(*) > 10 ORDER BY n_customers DESC, c_nationkey LIMIT 5""")
def r7(spark, sf):
    spec = QuerySpec("customer", group_by=["c_nationkey"],
                     aggregates=["count(*) AS n_customers", "round(avg(c_acctbal), 6) AS avg_bal"],
                     having="n_customers > 10", order_by=[("n_customers", "desc"), ("c_nationkey", "asc")],
                     limit=5)
    return spec.apply(_tables(spark, sf, ("customer",)))


@register("r8_raw_sql", """
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal FROM customer
WHERE c_acctbal > 0 GROUP BY c_mktsegment""")
def r8(spark, sf):
    return raw_sql(spark, "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal "
                          "FROM {customer} WHERE c_acctbal > :min_bal GROUP BY c_mktsegment",
                   _tables(spark, sf, ("customer",)), {"min_bal": 0})


@register("r12_first_row", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def r12(spark, sf):
    o = table(spark, sf, "orders")
    return first_row(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@register("r13_column_values", "SELECT DISTINCT c_mktsegment FROM customer")
def r13(spark, sf):
    return column_values(table(spark, sf, "customer"), "c_mktsegment").distinct()


@register("r10_update_order_limit", """
WITH hit AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM hit) THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
FROM customer""")
def r10(spark, sf):
    from hostlens.operators.kernels import update_top_k
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    out = update_top_k(c, "c_custkey", "c_mktsegment = 'BUILDING'", [F.col("c_acctbal").desc()], 10,
                       {"c_acctbal": F.col("c_acctbal") + 1})
    return out.select("c_custkey", "c_acctbal")


@register("r11_delete_order_limit", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 20)""")
def r11(spark, sf):
    from hostlens.operators.kernels import delete_top_k
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return delete_top_k(o, "o_orderkey", "o_orderstatus = 'O'", [F.col("o_totalprice")], 20) \
        .select("o_orderkey", "o_orderstatus")
