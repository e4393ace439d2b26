"""Registered change-set and write-kernel queries.

``customer`` is the state table; change sets are derived from its rows by
fixed rules (segment decides the action, a few columns carry bad values).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.operators import changes as E
from hostlens.operators import kernels as K
from hostlens.operators.file_table import FileTable
from hostlens.registry import register, table
from hostlens.session import scratch_path

RULES = [
    E.FieldRule("c_name", "varchar", 18, unique=True),
    E.FieldRule("c_acctbal", "int", 4),
    E.FieldRule("c_nationkey", "int", 2, has_reqs=True),
    E.FieldRule("c_mktsegment", "varchar", 10),
]


def change_rows(spark, sf, seq: str = "c_custkey"):
    """F7 batch form derived from ``customer``: (seq, action, pkid, field, value); ``seq`` is the order of records."""
    c = table(spark, sf, "customer")
    action = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("create")).otherwise(F.lit("edit"))
    name = F.concat(F.col("c_name"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("!")).otherwise(F.lit("")))
    bal = (F.when(F.col("c_acctbal") < 0, F.lit("n/a"))
           .when(F.col("c_mktsegment") == "MACHINERY", F.lit(""))
           .otherwise(F.floor("c_acctbal").cast("bigint").cast("string")))
    nat = F.when(F.col("c_nationkey") == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string"))
    fields = [F.struct(F.lit("c_name").alias("field"), name.alias("value")),
              F.struct(F.lit("c_acctbal").alias("field"), bal.alias("value")),
              F.struct(F.lit("c_nationkey").alias("field"), nat.alias("value")),
              F.struct(F.lit("DT_RowId").alias("field"), F.col("c_custkey").cast("string").alias("value")),
              F.struct(F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("c_comment"))
                       .otherwise(F.lit("c_mktsegment")).alias("field"),
                       F.regexp_replace(F.col("c_mktsegment"), "O", " ").alias("value"))]
    return c.select(F.expr(seq).cast("bigint").alias("seq"), action.alias("action"), F.col("c_custkey").alias("pkid"),
                    F.explode(F.array(*fields)).alias("_f")).select("seq", "action", "pkid", "_f.*")


_SQL_CHANGES = """
WITH c AS (SELECT * FROM customer),
ch AS (
  SELECT c_custkey AS seq, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'create' ELSE 'edit' END AS action,
         c_custkey AS pkid, f.field, f.value
  FROM c, unnest([
    {'field': 'c_name', 'value': c_name || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '!' ELSE '' END},
    {'field': 'c_acctbal', 'value': CASE WHEN c_acctbal < 0 THEN 'n/a' WHEN c_mktsegment = 'MACHINERY' THEN ''
                                         ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END},
    {'field': 'c_nationkey', 'value': CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END},
    {'field': 'DT_RowId', 'value': CAST(c_custkey AS VARCHAR)},
    {'field': CASE WHEN c_mktsegment = 'FURNITURE' THEN 'c_comment' ELSE 'c_mktsegment' END,
     'value': replace(c_mktsegment, 'O', chr(160))}]) AS t(f)),
rules AS (SELECT * FROM (VALUES ('c_name', 'varchar', 18, true, false), ('c_acctbal', 'int', 4, false, false),
                                ('c_nationkey', 'int', 2, false, true), ('c_mktsegment', 'varchar', 10, false, false))
          AS r(field, type, length, is_unique, has_reqs)),
j AS (SELECT ch.*, r.type, r.length, coalesce(r.is_unique, false) AS is_unique, coalesce(r.has_reqs, false) AS has_reqs,
             replace(coalesce(ch.value, ''), chr(160), ' ') AS v
      FROM ch LEFT JOIN rules r USING (field) WHERE ch.field <> 'DT_RowId'),
k AS (SELECT *, v = '' AS blank, TRY_CAST(trim(v) AS BIGINT) AS as_int, (v = '' AND has_reqs) AS optional_blank FROM j),
d AS (SELECT *, (optional_blank AND field LIKE 'fk\\_%' ESCAPE '\\') OR (type = 'date' AND blank)
                 OR (type = 'int' AND blank AND NOT optional_blank AND lower(action) = 'create')
                 OR field LIKE '%-many-count' AS "drop" FROM k),
o AS (SELECT *,
  CASE WHEN optional_blank AND type = 'int' AND NOT field LIKE 'fk\\_%' ESCAPE '\\' THEN '0'
       WHEN type = 'int' AND blank THEN CASE WHEN lower(action) = 'edit' THEN '^NULL^' END
       WHEN type = 'int' THEN CAST(as_int AS VARCHAR) ELSE v END AS out_value,
  CASE WHEN type IS NULL AND NOT field LIKE '%-many-count' THEN 'Unable to validate field "' || field || '"'
       WHEN "drop" THEN NULL
       WHEN type = 'varchar' AND length(v) > length THEN 'Data length (' || length(v) || ') greater than DB length of ' || length
       WHEN type = 'int' AND NOT blank AND as_int IS NULL THEN 'Required type int but submitted as class ''str'''
       WHEN type = 'int' AND NOT blank AND length > 0 AND length(CAST(as_int AS VARCHAR)) > length
         THEN 'Data length (' || length(CAST(as_int AS VARCHAR)) || ') greater than DB length of ' || length
  END AS status0 FROM d),
clash AS (SELECT DISTINCT o.seq, o.field FROM o JOIN c ON o.field = 'c_name' AND o.out_value = c.c_name
          WHERE o.is_unique AND o.status0 IS NULL AND NOT o."drop"
            AND (lower(o.action) = 'create' OR CAST(c.c_custkey AS VARCHAR) <> CAST(o.pkid AS VARCHAR))),
firsts AS (SELECT field, out_value, min(seq) AS first_seq FROM o WHERE is_unique AND status0 IS NULL AND NOT "drop"
           GROUP BY 1, 2),
v AS (SELECT o.seq, o.action, o.pkid, o.field, o.value, o.out_value, o."drop",
        CASE WHEN o.status0 IS NOT NULL THEN o.status0
             WHEN clash.seq IS NOT NULL OR (o.is_unique AND f.first_seq IS NOT NULL AND o.seq > f.first_seq)
               THEN 'Duplicate data, modify to be unique.' END AS status
      FROM o LEFT JOIN clash ON o.seq = clash.seq AND o.field = clash.field
      LEFT JOIN firsts f ON o.field = f.field AND o.out_value = f.out_value)"""


def _validated(spark, sf):
    return E.validate(change_rows(spark, sf), RULES, table(spark, sf, "customer"), "c_custkey")


@register("e2_validate", _SQL_CHANGES + """
SELECT seq, action, pkid, field, value, out_value, "drop", status FROM v""")
def e2(spark, sf):
    return _validated(spark, sf)


@register("e2_record_status", _SQL_CHANGES + """
SELECT seq, action, pkid, count(status) = 0 AS valid, count(status) AS n_errors,
  coalesce(string_agg(field || ': ' || status, '; ' ORDER BY field, status), '') AS errors
FROM v GROUP BY seq, action, pkid""")
def e2r(spark, sf):
    r = E.record_status(_validated(spark, sf))
    return r.select("seq", "action", "pkid", "valid", F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join(F.transform("errors", lambda e: F.concat(e["name"], F.lit(": "), e["status"])),
                                 "; ").alias("errors"))


@register("e2_stored_types", """
WITH v AS (SELECT c_custkey AS seq, f.field, f.value FROM customer, unnest([
    {'field': 'c_nationkey', 'value': CASE WHEN c_custkey % 3 = 0 THEN '9' || CAST(c_custkey + 9000000000 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END},
    {'field': 'since', 'value': CASE WHEN c_custkey % 5 = 0 THEN '2020-02-30' WHEN c_custkey % 5 = 1 THEN 'someday' ELSE '2020-02-28' END}]) AS t(f))
SELECT seq, field, CASE WHEN field = 'c_nationkey' AND TRY_CAST(value AS INTEGER) IS NULL THEN 'Not a value of type int'
  WHEN field = 'since' AND TRY_CAST(value AS DATE) IS NULL THEN 'Not a value of type date' END AS status FROM v""")
def e2_stored(spark, sf):
    # numbers beyond the stored type and dates the calendar has not: errors of their rows
    c = table(spark, sf, "customer")
    state = c.select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.lit("2020-01-01").cast("date").alias("since"))
    k = F.col("c_custkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("9"), (k + F.lit(9000000000)).cast("string"))).otherwise(k.cast("string"))
    day = F.when(k % 5 == 0, "2020-02-30").when(k % 5 == 1, "someday").otherwise("2020-02-28")
    fields = F.array(F.struct(F.lit("c_nationkey").alias("field"), number.alias("value")), F.struct(F.lit("since").alias("field"), day.alias("value")))
    changes = c.select(k.cast("bigint").alias("seq"), F.lit("edit").alias("action"), k.alias("pkid"), F.explode(fields).alias("_f")).select("seq", "action", "pkid", "_f.*")
    rules = [E.FieldRule("c_nationkey", "int", 12), E.FieldRule("since", "date")]
    return E.validate(changes, rules, state, "c_custkey").select("seq", "field", "status")


@register("e2_handed_over", """
WITH r AS (SELECT c_custkey AS k, c_custkey % 3 AS place, c_nationkey = 0 AS bad FROM customer),
v AS (SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY k // 3 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS kept FROM r)
SELECT k AS seq, CASE WHEN place > 0 AND kept AND EXISTS (SELECT 1 FROM r WHERE r.k = v.k - 1) THEN 'Duplicate data, modify to be unique.' END AS status FROM v""")
def e2_handed_over(spark, sf):
    # in threes, each customer takes the name that the one before has just given up, unless that record was refused
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    before = F.format_string("Customer#%09d", k - 1)
    name = F.when(k % 3 == 0, F.concat(F.lit("new "), k.cast("string"))).otherwise(before)
    fields = F.array(F.struct(F.lit("c_name").alias("field"), name.alias("value")),
                     F.struct(F.lit("c_mktsegment").alias("field"), F.when(F.col("c_nationkey") == 0, "far too long").otherwise("ok").alias("value")))
    changes = c.select(k.cast("bigint").alias("seq"), F.lit("edit").alias("action"), k.alias("pkid"), F.explode(fields).alias("_f")).select("seq", "action", "pkid", "_f.*")
    checked = E.validate(changes, RULES, c, "c_custkey")
    return checked.where("field = 'c_name'").select("seq", "status")


# the batch in an order that puts the records that can be valid first, by falling balance: it stops midway
_BALANCE_FIRST = ("CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 0 ELSE 1000000000000000 END"
                  " + (1000000 - CAST(floor(c_acctbal) AS BIGINT)) * 10000000 + c_custkey")
_UNTIL_BAD = """
SELECT seq, field, out_value FROM v WHERE seq < coalesce((SELECT min(seq) FROM v WHERE status IS NOT NULL), 9223372036854775807)"""


def _reordered(seq: str) -> str:
    return _SQL_CHANGES.replace("SELECT c_custkey AS seq,", f"SELECT {seq} AS seq,", 1)


@register("e12_until_first_bad", _reordered(_BALANCE_FIRST) + _UNTIL_BAD)
def e12(spark, sf):
    v = E.validate(change_rows(spark, sf, _BALANCE_FIRST), RULES, table(spark, sf, "customer"), "c_custkey")
    return E.until_first_bad(v).select("seq", "field", "out_value")


@register("e12_valid_only", _SQL_CHANGES + """
SELECT seq, field, out_value FROM v WHERE seq NOT IN (SELECT seq FROM v WHERE status IS NOT NULL)""")
def e12v(spark, sf):
    return E.valid_only(_validated(spark, sf)).select("seq", "field", "out_value")


@register("e1_form_keys", """
SELECT CAST(c_custkey AS VARCHAR) AS pkid, f.field, f.value, f.is_file FROM customer, unnest([
  {'field': 'c_name', 'value': c_name, 'is_file': false},
  {'field': 'c_mktsegment', 'value': c_mktsegment, 'is_file': false},
  {'field': 'files', 'value': CAST(c_nationkey AS VARCHAR), 'is_file': true},
  {'field': 'files-many-count', 'value': '1', 'is_file': false},
  {'field': 'DT_RowId', 'value': CAST(c_custkey AS VARCHAR), 'is_file': false}]) AS t(f)""")
def e1(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    pair = lambda key, val: F.struct(key.alias("key"), val.alias("value"))
    pairs = c.select(F.explode(F.array(
        pair(F.lit("action"), F.lit("edit")),
        pair(F.format_string("data[%s][main][c_name]", k), F.col("c_name")),
        pair(F.format_string("data[%s][main][c_mktsegment]", k), F.col("c_mktsegment")),
        pair(F.format_string("data[%s][files][0][id]", k), F.col("c_nationkey").cast("string")),
        pair(F.format_string("data[%s][files-many-count]", k), F.lit("1")),
        pair(F.format_string("data[%s][DT_RowId]", k), k))).alias("p")).select("p.*")
    return E.parse_form(pairs).select("pkid", "field", "value", "is_file")


@register("e3_new_lookup_values", """
WITH labels AS (SELECT DISTINCT c_mktsegment AS n_name FROM customer
                UNION SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
known AS (SELECT l.n_name, CAST(n.n_nationkey AS BIGINT) AS n_nationkey, false AS is_new FROM labels l JOIN nation n USING (n_name)),
unknown AS (SELECT n_name FROM labels WHERE n_name NOT IN (SELECT n_name FROM nation))
SELECT * FROM known UNION ALL
SELECT n_name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY n_name), true FROM unknown""")
def e3(spark, sf):
    c, s, n = (table(spark, sf, x) for x in ("customer", "supplier", "nation"))
    labels = c.select(F.col("c_mktsegment").alias("n_name")).unionByName(
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name"))
    look = n.select("n_name", F.col("n_nationkey").cast("bigint").alias("n_nationkey"))
    return E.new_lookup_values(labels, look, "n_name", "n_nationkey")


_STATE = "SELECT c_custkey, c_name, c_nationkey FROM customer"


@register("k1_append_keys", _STATE + """ UNION ALL
SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name, s_nationkey FROM supplier""")
def k1(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("c_name"),
                                               F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    new = K.assign_keys(state, rows, "c_custkey", ["s_suppkey"]).drop("s_suppkey")
    return state.unionByName(new)


@register("k2_insert_ignore", """
SELECT c_custkey, c_name FROM customer UNION ALL
SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer)""")
def k2(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_name")
    again = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("_seq"), "c_custkey", "c_name")
    fresh = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("_seq"),
                                                (F.col("s_suppkey") + 1000000).alias("c_custkey"),
                                                F.col("s_name").alias("c_name"))
    return K.insert_ignore(state, again.unionByName(fresh), "c_name", seq="_seq").drop("_seq")


@register("k3_upsert", """
WITH r AS (SELECT c_custkey, NULL::VARCHAR AS c_name, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
           UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier)
SELECT coalesce(s.c_custkey, r.c_custkey) AS c_custkey, coalesce(r.c_name, s.c_name) AS c_name,
  coalesce(r.c_acctbal, s.c_acctbal) AS c_acctbal
FROM (SELECT c_custkey, c_name, c_acctbal FROM customer) s FULL OUTER JOIN r ON s.c_custkey = r.c_custkey""")
def k3(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    a = table(spark, sf, "customer").where("c_mktsegment = 'AUTOMOBILE'").select(
        "c_custkey", F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 100).alias("c_acctbal"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"),
                                            F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return K.upsert(state, a.unionByName(b), "c_custkey")


def _k4(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    ch = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(
        "c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), F.lit(True).alias("_set_c_acctbal"),
        F.lit(None).cast("string").alias("c_mktsegment"), (F.col("c_acctbal") < 0).alias("_set_c_mktsegment"))
    return state, K.update(state, ch, "c_custkey", ["c_acctbal", "c_mktsegment"])


_SQL_K4 = """
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"""


@register("k4_update", _SQL_K4)
def k4(spark, sf):
    return _k4(spark, sf)[1]


@register("r14_affected_count", """
SELECT 0::BIGINT AS n_inserted, 0::BIGINT AS n_deleted,
  count(*) FILTER (WHERE c_mktsegment = 'MACHINERY' AND (c_acctbal <> 0 OR c_acctbal < 0)) AS n_updated FROM customer""")
def r14(spark, sf):
    before, after = _k4(spark, sf)
    return K.affected(before, after, "c_custkey")


@register("k5_delete", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0)")
def k5(spark, sf):
    c = table(spark, sf, "customer")
    return K.delete(c.select("c_custkey", "c_name"), c.where("c_nationkey = 0"), "c_custkey")


@register("e7_read_back", """
SELECT c_custkey, 'c_acctbal' AS field, CAST(c_acctbal * 2 AS VARCHAR) AS requested, CAST(c_acctbal AS VARCHAR) AS stored
FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal * 2 <> c_acctbal""")
def e7(spark, sf):
    c = table(spark, sf, "customer")
    requested = c.where("c_mktsegment = 'MACHINERY'").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"))
    stored = c.join(requested.select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "c_acctbal")
    return E.read_back(requested, stored, "c_custkey")


@register("e8_dependency_count", """
SELECT * FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n, 'customer' AS ref_table FROM customer GROUP BY 1
               UNION ALL SELECT s_nationkey, count(*), 'supplier' FROM supplier GROUP BY 1)
WHERE n_nationkey IN (SELECT n_nationkey FROM nation)""")
def e8(spark, sf):
    c, s, n = (table(spark, sf, x) for x in ("customer", "supplier", "nation"))
    return E.dependency_counts(n, "n_nationkey", [("customer", c, "c_nationkey"), ("supplier", s, "s_nationkey")])


@register("e9_guarded_delete", """
SELECT p_partkey, coalesce(d.n, 0) AS n_dependents, coalesce(d.n, 0) = 0 AS deleted
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) d ON p_partkey = d.l_partkey
WHERE p_size > 45""")
def e9(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    _, report = E.guarded_delete(p, p.where("p_size > 45"), "p_partkey", [("lineitem", li, "l_partkey")])
    return report


@register("e10_reorder", """
SELECT a.c_custkey, coalesce(b.c_custkey * 10, a.c_custkey * 10) AS row_order
FROM customer a LEFT JOIN customer b ON b.c_custkey = xor(a.c_custkey, 1)""")
def e10(spark, sf):
    c = table(spark, sf, "customer")
    state = c.select("c_custkey", (F.col("c_custkey") * 10).alias("row_order"))
    mapping = c.select("c_custkey", F.col("c_custkey").bitwiseXOR(F.lit(1)).alias("names"))
    return E.reorder(state, mapping, "c_custkey", "row_order", "names")


@register("e11_duplicate_row", """
SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey) AS c_custkey, c_name, c_nationkey
FROM customer WHERE c_mktsegment = 'BUILDING'""")
def e11(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("_src"), "c_name", "c_nationkey")
    return K.assign_keys(c, rows, "c_custkey", ["_src"]).drop("_src")


@register("e2i_coded_field", """
WITH ch AS (SELECT c_custkey AS seq, c_custkey AS pkid, 'device_type' AS field,
                   CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'MACHINERY' THEN '2'
                                     WHEN 'HOUSEHOLD' THEN '7' ELSE '0' END AS value FROM customer
            UNION ALL SELECT c_custkey, c_custkey, 'c_name', c_name FROM customer),
codes AS (SELECT * FROM (VALUES ('0', 'ios', '0'), ('0', 'server', '0'), ('1', 'ios', '1'), ('1', 'server', '0'),
                                ('2', 'ios', '0'), ('2', 'server', '1')) AS t(code, f, v))
SELECT seq, pkid, field, value FROM ch WHERE field <> 'device_type'
UNION ALL SELECT ch.seq, ch.pkid, codes.f, codes.v FROM ch JOIN codes ON ch.field = 'device_type' AND ch.value = codes.code""")
def e2i(spark, sf):
    c = table(spark, sf, "customer")
    code = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "1").when(F.col("c_mktsegment") == "MACHINERY", "2")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "7").otherwise("0"))
    ch = c.select(F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("pkid"),
                  F.explode(F.array(F.struct(F.lit("device_type").alias("field"), code.alias("value")),
                                    F.struct(F.lit("c_name").alias("field"), F.col("c_name").alias("value"))))
                  .alias("_f")).select("seq", "pkid", "_f.*")
    return E.expand_coded(ch)


@register("e4_apply_edits", _SQL_CHANGES + """,
bad AS (SELECT DISTINCT seq FROM v WHERE status IS NOT NULL),
ok AS (SELECT * FROM v WHERE seq NOT IN (SELECT seq FROM bad) AND NOT "drop" AND lower(action) = 'edit'),
w AS (SELECT pkid, max(CASE WHEN field = 'c_name' THEN out_value END) AS n_name, bool_or(field = 'c_name') AS s_name,
             max(CASE WHEN field = 'c_acctbal' THEN out_value END) AS n_bal, bool_or(field = 'c_acctbal') AS s_bal,
             max(CASE WHEN field = 'c_nationkey' THEN out_value END) AS n_nat, bool_or(field = 'c_nationkey') AS s_nat
      FROM ok GROUP BY pkid)
SELECT c.c_custkey,
  CASE WHEN coalesce(w.s_name, false) THEN nullif(w.n_name, '^NULL^') ELSE c.c_name END AS c_name,
  CASE WHEN coalesce(w.s_bal, false) THEN CAST(nullif(w.n_bal, '^NULL^') AS DOUBLE) ELSE c.c_acctbal END AS c_acctbal,
  CASE WHEN coalesce(w.s_nat, false) THEN CAST(nullif(w.n_nat, '^NULL^') AS INTEGER) ELSE c.c_nationkey END AS c_nationkey
FROM customer c LEFT JOIN w ON c.c_custkey = w.pkid""")
def e4(spark, sf):
    fields = ["c_name", "c_acctbal", "c_nationkey"]
    state = table(spark, sf, "customer").select("c_custkey", *fields)
    ch = E.edits_to_changes(_validated(spark, sf), fields, key="c_custkey")
    return K.update(state, ch, "c_custkey", fields)


_SEGMENT_FIRST = "CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1000000000000000 END + c_custkey"


@register("e12_until_first_bad_segment", _reordered(_SEGMENT_FIRST) + _UNTIL_BAD)
def e12s(spark, sf):
    v = E.validate(change_rows(spark, sf, _SEGMENT_FIRST), RULES, table(spark, sf, "customer"), "c_custkey")
    return E.until_first_bad(v).select("seq", "field", "out_value")


# ---- sequences: the last edit wins, owners of unique values, duplicate keys, empty tables ----

@register("e4_conflicting_edits", """
SELECT c_custkey, CAST(coalesce(l.q, c_acctbal) AS DOUBLE) AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey, arg_max(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS q FROM orders GROUP BY 1) l
  ON o_custkey = c_custkey""")
def e4_conflict(spark, sf):
    # every order is an edit of its customer's balance; edits are applied in order key order
    ch = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lit("edit").alias("action"), F.col("o_custkey").alias("pkid"), F.lit("c_acctbal").alias("field"),
        F.floor("o_totalprice").cast("bigint").cast("string").alias("value"))
    state = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    v = E.validate(ch, [E.FieldRule("c_acctbal", "int", 12)], state, "c_custkey")
    return K.update(state, E.edits_to_changes(v, ["c_acctbal"], "c_custkey"), "c_custkey", ["c_acctbal"])


@register("e2f_same_row", """
WITH e AS (SELECT o_orderkey AS seq, o_custkey AS pkid, CASE WHEN o_orderstatus = 'P' THEN o_custkey % 1000 ELSE o_custkey END AS name FROM orders),
n AS (SELECT seq, pkid, 'Customer#' || lpad(CAST(name AS VARCHAR), 9, '0') AS value FROM e),
firsts AS (SELECT value, arg_min(owner, s) AS owner FROM (
  SELECT value, pkid AS owner, seq AS s FROM n UNION ALL SELECT c_name, c_custkey, -1 FROM customer) GROUP BY 1)
SELECT seq, pkid, value, CASE WHEN pkid <> owner THEN 'Duplicate data, modify to be unique.' END AS status FROM n JOIN firsts USING (value)""")
def e2f(spark, sf):
    # customers send their own name again and again, now and then one that may be another's
    who = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") % 1000).otherwise(F.col("o_custkey"))
    ch = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lit("edit").alias("action"), F.col("o_custkey").alias("pkid"), F.lit("c_name").alias("field"),
        F.concat(F.lit("Customer#"), F.lpad(who.cast("string"), 9, "0")).alias("value"))
    v = E.validate(ch, [E.FieldRule("c_name", "varchar", 18, unique=True)], table(spark, sf, "customer"), "c_custkey")
    return v.select("seq", "pkid", "value", "status")


@register("k3_duplicate_keys", """
WITH r AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal,
                  arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS c_mktsegment FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(r.c_acctbal, s.c_acctbal) AS c_acctbal, coalesce(r.c_mktsegment, s.c_mktsegment) AS c_mktsegment
FROM customer s FULL OUTER JOIN r USING (c_custkey)""")
def k3_dup(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
                                             F.nullif("o_orderstatus", F.lit("O")).alias("c_mktsegment"), "o_orderkey")
    return K.upsert(state, rows, "c_custkey", seq="o_orderkey")


@register("k1_empty_table", "SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_name FROM supplier")
def k1_empty(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    empty = rows.select(F.col("s_suppkey").alias("id"), "s_name").limit(0)
    return K.append_with_keys(empty, rows, "id", ["s_suppkey"]).select("id", "s_name")


# ---- single rules ----

@register("e2c_dates", """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'O' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, o_orderstatus = 'O' AS dropped
FROM orders""")
def e2c(spark, sf):
    day = F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ch = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("edit").alias("action"), F.col("o_orderkey").alias("pkid"),
                                           F.lit("o_orderdate").alias("field"), day.alias("value"))
    v = E.validate(ch, [E.FieldRule("o_orderdate", "date")], table(spark, sf, "orders"), "o_orderkey")
    return v.select("seq", "value", F.col("drop").alias("dropped"))


@register("e2d_required", """
WITH b AS (SELECT c_custkey AS seq, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'create' ELSE 'edit' END AS action FROM customer)
SELECT seq, 'fk_nation' AS field, action = 'edit' AS dropped, CASE WHEN action = 'edit' THEN '^NULL^' END AS out_value FROM b
UNION ALL SELECT seq, 'size', false, '0' FROM b
UNION ALL SELECT seq, 'need', action = 'create', CASE WHEN action = 'edit' THEN '^NULL^' END FROM b""")
def e2d(spark, sf):
    # blank fields: a foreign key required on insert only, an int never required, an int always required
    c = table(spark, sf, "customer")
    action = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "create").otherwise("edit")
    ch = c.select(F.col("c_custkey").alias("seq"), action.alias("action"), F.col("c_custkey").alias("pkid"),
                  F.explode(F.array(F.lit("fk_nation"), F.lit("size"), F.lit("need"))).alias("field"), F.lit("").alias("value"))
    rules = [E.FieldRule("fk_nation", "int", has_reqs=True, required_insert=True), E.FieldRule("size", "int", has_reqs=True),
             E.FieldRule("need", "int", has_reqs=True, required_insert=True, required_update=True)]
    v = E.validate(ch, rules, c, "c_custkey")
    # a required foreign key left blank on insert is an unset int, which a create leaves out
    shown = F.when(F.col("field") == "fk_nation", F.lower("action") == "edit").otherwise(F.col("drop"))
    return v.select("seq", "field", shown.alias("dropped"), "out_value")


@register("e2g_multi_counts", """
WITH b AS (SELECT o_orderkey AS seq, CAST(o_custkey % 3 AS VARCHAR) AS n, o_orderstatus = 'F' AS has FROM orders)
SELECT seq, 'parts' AS field, CASE WHEN NOT has AND n <> '0' THEN 'System error: No field found for multi-select' END AS status
FROM b WHERE has OR n <> '0' OR n = '0'""")
def e2g(spark, sf):
    o = table(spark, sf, "orders")
    pair = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("parts").alias("field"), F.lit("1,2").alias("value")))) \
        .otherwise(F.array().cast("array<struct<field:string,value:string>>"))
    count = F.array(F.struct(F.lit("parts-many-count").alias("field"), (F.col("o_custkey") % 3).cast("string").alias("value")))
    ch = o.select(F.col("o_orderkey").alias("seq"), F.lit("edit").alias("action"), F.col("o_orderkey").alias("pkid"),
                  F.explode(F.concat(pair, count)).alias("f")).select("seq", "action", "pkid", "f.*")
    v = E.validate(ch, [E.FieldRule("parts", "varchar", 40)], o, "o_orderkey")
    return v.where("field = 'parts'").select("seq", "field", "status")


# ---- creates, scope, seeds ----

_CREATED = """
WITH m AS (SELECT max(c_custkey) AS m FROM customer),
n AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier
      WHERE s_acctbal >= 0)"""


def _create_rows(spark, sf):
    s = table(spark, sf, "supplier")
    bal = F.when(F.col("s_acctbal") < 0, F.lit("none")).when(F.col("s_nationkey") == 0, F.lit("")).otherwise(F.floor("s_acctbal").cast("bigint").cast("string"))
    fields = [F.struct(F.lit("c_name").alias("field"), F.col("s_name").alias("value")), F.struct(F.lit("c_acctbal").alias("field"), bal.alias("value"))]
    return s.select(F.col("s_suppkey").alias("seq"), F.lit("create").alias("action"), F.lit(0).cast("bigint").alias("pkid"),
                    F.explode(F.array(*fields)).alias("f")).select("seq", "action", "pkid", "f.*")


_CREATE_RULES = [E.FieldRule("c_name", "varchar", 25, unique=True), E.FieldRule("c_acctbal", "int", 6)]


@register("e5_create", _CREATED + """
SELECT s_suppkey AS seq, m + k AS c_custkey, n.s_name AS c_name,
  CASE WHEN s_nationkey = 0 THEN NULL ELSE CAST(floor(s_acctbal) AS DOUBLE) END AS c_acctbal
FROM n JOIN supplier USING (s_suppkey), m""")
def e5(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    v = E.validate(_create_rows(spark, sf), _CREATE_RULES, state, "c_custkey")
    return E.creates_to_rows(state, v, ["c_name", "c_acctbal"], "c_custkey")


@register("e6_scope_stamp", _CREATED + """
SELECT m + k AS c_custkey, s_name AS c_name, 7 AS c_nationkey FROM n, m
UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer""")
def e6(spark, sf):
    state = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    out = E.apply_edits(state, _create_rows(spark, sf), _CREATE_RULES, "c_custkey", scope=("c_nationkey", 7), stop=False)
    return out.state.select("c_custkey", "c_name", "c_nationkey")


@register("e13_seed", """
SELECT n_nationkey + 1 AS pkid, n_name AS name, true AS seeded_twice FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS n_nationkey, n_name FROM nation)
UNION ALL SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_name), r_name, false FROM region""")
def e13(spark, sf):
    # an absent table is created with the nations, then seeded again with nations and regions
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("seeded_twice"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit(False).alias("seeded_twice"))
    first = E.seed(None, n, "name", key="pkid")
    return E.seed(first, n.withColumn("seeded_twice", F.lit(False)).unionByName(r), "name", key="pkid").select("pkid", "name", "seeded_twice")


# ---- references ----

def _referring(spark, sf):
    """Tables that refer to parts by one key and by lists: an order's parts, a line's part."""
    li = table(spark, sf, "lineitem")
    lines = li.select("l_orderkey", F.col("l_partkey").alias("fk_part"), F.lit("x").alias("fk_partner"))
    lists = li.groupBy("l_orderkey").agg(F.concat_ws(",", F.collect_list(F.col("l_partkey").cast("string"))).alias("fk_part_list"))
    return {"lines": lines, "baskets": lists}


_SQL_REFS = """
WITH d AS (SELECT l_partkey AS p_partkey, count(*) AS n, 'lines' AS ref_table FROM lineitem GROUP BY 1
           UNION ALL SELECT l_partkey, count(DISTINCT l_orderkey), 'baskets' FROM lineitem GROUP BY 1)"""


@register("e8_list_refs", _SQL_REFS + " SELECT p_partkey, n, ref_table FROM d WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def e8l(spark, sf):
    asked = table(spark, sf, "part").where("p_size > 45")
    return E.dependency_counts(asked, "p_partkey", E.reference_columns(_referring(spark, sf), "part"))


@register("e9_next_state", """
SELECT p_partkey, p_name FROM part WHERE NOT (p_size > 45 AND p_partkey NOT IN (
  SELECT l_partkey FROM lineitem WHERE l_quantity > 40))""")
def e9n(spark, sf):
    # only large lines hold their part, so that some requested parts are free
    p = table(spark, sf, "part")
    refs = E.reference_columns({"large": table(spark, sf, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(
        F.concat_ws(", ", F.collect_list(F.col("l_partkey").cast("string"))).alias("fk_part_list"))}, "part")
    after, _ = E.guarded_delete(p, p.where("p_size > 45"), "p_partkey", refs)
    return after.select("p_partkey", "p_name")


@register("e10_form_reorder", """
SELECT a.c_custkey, coalesce(b.c_custkey * 10, a.c_custkey * 10) AS row_order
FROM customer a LEFT JOIN customer b ON b.c_custkey = xor(a.c_custkey, 1)""")
def e10f(spark, sf):
    c = table(spark, sf, "customer")
    state = c.select("c_custkey", (F.col("c_custkey") * 10).alias("row_order"))
    ch = c.select(F.col("c_custkey").alias("seq"), F.lit("edit").alias("action"), F.col("c_custkey").alias("pkid"), F.lit("DT_RowId").alias("field"),
                  F.col("c_custkey").bitwiseXOR(F.lit(1)).cast("string").alias("value"))
    once = E.reorder_changes(state, ch, "c_custkey", "row_order")
    # a post that holds another field as well leaves the order alone
    mixed = ch.unionByName(ch.limit(1).withColumn("field", F.lit("row_order")))
    return E.reorder_changes(once, mixed, "c_custkey", "row_order")


# ---- the whole pipeline: posted pairs to the next table ----

_POST_RULES = [E.FieldRule("name", "varchar", 30, unique=True), E.FieldRule("size", "int", 3), E.FieldRule("fk_nation", "int"),
               E.FieldRule("files", "varchar", 200), E.FieldRule("tags", "varchar", 60)]


def _post(spark, sf, action: str):
    """One pair per posted key: customers with their nation by name (one nation is new), two files and two list values each."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("data["), F.col("c_custkey").cast("string"), F.lit("]"))
    nation = F.when(F.col("c_nationkey") == 3, F.lit("ATLANTIS")).otherwise(F.col("n_name"))
    pairs = [("[main][name]", F.concat(F.col("c_name"), F.lit("+"))), ("[main][size]", F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit("12"))),
             ("[main][fk_nation]", nation), ("[uploads][0][id]", F.lit("7")), ("[uploads][1][id]", F.col("c_nationkey").cast("string")),
             ("[uploads-many-count]", F.lit("2")), ("[main][tags][]", F.lit("a")), ("[main][tags][]", F.lit("b")), ("[DT_RowId]", F.lit("x"))]
    posted = c.select("c_custkey", F.posexplode(F.array(*[F.struct(F.concat(key, F.lit(k)).alias("key"), v.cast("string").alias("value"))
                                                         for k, v in pairs])).alias("i", "p"))
    rows = posted.select((F.col("c_custkey") * 100 + F.col("i")).alias("pos"), "p.*")
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("pos"), F.lit("action").alias("key"), F.lit(action).alias("value"))
    return rows.unionByName(head)


@register("e_pipeline_edit", """
SELECT c_custkey, c_name || '+' AS name, CASE WHEN c_acctbal < 0 THEN NULL ELSE 12 END AS size,
  CASE WHEN c_nationkey = 3 THEN (SELECT max(n_nationkey) + 1 FROM nation) ELSE c_nationkey END AS fk_nation,
  '[{"id":"7"},{"id":"' || c_nationkey || '"}]' AS files, 'a,b' AS tags FROM customer""")
def e_pipeline(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("pkid"), F.col("n_name").alias("name"))
    state = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit(0).alias("size"),
                                                F.col("c_nationkey").cast("bigint").alias("fk_nation"), F.lit("").alias("files"), F.lit("").alias("tags"))
    ch = E.form_changes(_post(spark, sf, "edit"), upload_many={"uploads": "files"})
    return E.apply_edits(state, ch, _POST_RULES, "c_custkey", tags={"nation": E.Tag(nations, "name")}).state


# ---- copy on write by file, with the affected rows counted while writing ----

def _file_table(spark, sf):
    """Customers in files of some hundred rows, changed three times: (table, counts of the changes)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files = FileTable(spark, scratch_path(spark, "file-table"), "c_custkey", file_rows=max(100, c.count() // 20))
    files.create(c)
    k = F.col("c_custkey")
    low = c.where(k < 100)
    counts = [files.upsert(low.where(k < 50).select(k, F.concat("c_name", F.lit("!")).alias("c_name"))
                           .unionByName(low.where(k < 10).select((k - 10).alias("c_custkey"), F.lit("early").alias("c_name")))),
              files.update(low.select(k, (F.col("c_acctbal") * 2).alias("c_acctbal"), (F.col("c_acctbal") < 0).alias("_set_c_acctbal")), ["c_acctbal"]),
              files.delete(low.where(k % 10 == 3))]
    return files, counts


_SQL_FILES = """
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey < 50 THEN c_name || '!' ELSE c_name END AS c_name,
                  CASE WHEN c_custkey < 100 AND c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer
           UNION ALL SELECT c_custkey - 10, 'early', NULL FROM customer WHERE c_custkey < 10)"""


@register("k_files_changed", _SQL_FILES + """
SELECT * FROM s WHERE NOT (c_custkey >= 0 AND c_custkey < 100 AND c_custkey % 10 = 3)""")
def k_files(spark, sf):
    return _file_table(spark, sf)[0].read()


@register("r14_counted_while_writing", """
SELECT 'upsert' AS change, (SELECT count(*) FROM customer WHERE c_custkey < 10) AS n_inserted, 0::BIGINT AS n_deleted,
  (SELECT count(*) FROM customer WHERE c_custkey < 50) AS n_updated
UNION ALL SELECT 'update', 0, 0, (SELECT count(*) FROM customer WHERE c_custkey < 100 AND c_acctbal < 0)
UNION ALL SELECT 'delete', 0, (SELECT count(*) FROM customer WHERE c_custkey < 100 AND c_custkey % 10 = 3), 0""")
def r14_counted(spark, sf):
    counts = _file_table(spark, sf)[1]
    return spark.createDataFrame([(name, c["n_inserted"], c["n_deleted"], c["n_updated"]) for name, c in zip(("upsert", "update", "delete"), counts)],
                                 "change string, n_inserted long, n_deleted long, n_updated long")
