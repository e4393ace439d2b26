"""Registered ingestion queries (I1-I9): events rendered as raw files, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.address import IPV4, address_to_name
from hostlens.functions.headings import normalize_headings
from hostlens.functions.timefmt import normalize_time_text, time_losses
from hostlens.plans.template import errors as template_errors
from hostlens.plans.template import extract
from hostlens.session import scratch_path
from hostlens.sources.counters import read_counters, stack
from hostlens.sources.inventory import inventory, inventory_lookup, refresh_inventory
from hostlens.sources.lines import raw_lines, read_lines, text_lines
from hostlens.sources.render import render_counter_csv, render_device_log, render_document_csv
from hostlens.registered.common import building_hosts
from hostlens.registry import register, table

COUNTER = "Events\\purchase"

# Fixed value: the sample template of the reference's demo (device call counts).
CALLS_TEMPLATE = r"""Value timestamp (.+\d+:\d+:\d+.+\d+)
Value Filldown hostname (\S+)
Value total_calls (.+)


Start
  ^.*Query @ ${timestamp}
  ^${hostname}[>#].*
  ^Total Number of Active Calls : ${total_calls} -> Record"""


_RENDERED: dict = {}


def _rendered(spark, sf, kind, fn):
    """Render once per application and table set (inputs are immutable)."""
    k = (spark.sparkContext.applicationId, sf.rstrip("/"), kind)
    if k not in _RENDERED:
        _RENDERED[k] = fn(table(spark, sf, "events"), scratch_path(spark, kind))
    return _RENDERED[k]


def counter_files(spark, sf):
    return _rendered(spark, sf, "counters", render_counter_csv)


def log_files(spark, sf):
    return _rendered(spark, sf, "logs", render_device_log)


@register("i1_counter_csv", """
SELECT strftime(ts, '%m/%d/%Y %H:%M:%S') AS "Timestamp", 'HOST' || CAST(user_id AS VARCHAR) AS "Hostname",
  CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS "Events\\purchase" FROM events""")
def i1(spark, sf):
    rows, _ = read_counters(spark, counter_files(spark, sf), COUNTER)
    return rows.select(normalize_time_text("time_text").alias("Timestamp"), "Hostname", F.col(f"`{COUNTER}`"))


@register("i1_quoted_breaks", """
SELECT 'DOCS-' || coalesce(source, 'none') AS "Hostname", CAST(doc_id AS VARCHAR) AS "Id",
  CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS DOUBLE) END AS "Chars" FROM documents""")
def i1_quoted(spark, sf):
    # texts with line breaks and quotes in quoted cells, and lines without their last cells
    k = (spark.sparkContext.applicationId, sf.rstrip("/"), "documents")
    if k not in _RENDERED:
        _RENDERED[k] = render_document_csv(table(spark, sf, "documents"), scratch_path(spark, "document-csv"))
    rows, _ = read_counters(spark, _RENDERED[k], "Texts\\chars")
    return rows.select("Hostname", F.col("time_text").alias("Id"), F.col("`Texts\\chars`").alias("Chars"))


@register("i2_line_scan", """
SELECT 'cube' || CAST(user_id AS VARCHAR) AS host, count(*) * 2 + 1 AS n_lines, count(*) * 2 AS last_line_no,
  count(*) * 2 * (count(*) * 2 + 1) // 2 AS sum_line_no FROM events GROUP BY user_id""")
def i2(spark, sf):
    lines = read_lines(spark, log_files(spark, sf))
    host = F.regexp_extract("file", r"host=([^/]+)/", 1)
    return lines.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n_lines"),
                                                 F.max("line_no").alias("last_line_no"),
                                                 F.sum("line_no").alias("sum_line_no"))


@register("i2_document_lines", """
SELECT doc_id, line_no, length(line) AS n_chars FROM (
  SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))""")
def i2d(spark, sf):
    d = text_lines(table(spark, sf, "documents"), "doc_id", "text")
    return d.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.length("line").alias("n_chars"))


@register("i3_template_extract", """
SELECT strftime(ts, '%m/%d/%Y %H:%M:%S') AS "Timestamp", 'cube' || CAST(user_id AS VARCHAR) AS "Hostname",
  printf('%.2f', value) AS "Total Calls" FROM events
UNION ALL SELECT '', 'cube' || CAST(user_id AS VARCHAR), '' FROM events GROUP BY user_id""")
def i3(spark, sf):
    lines = raw_lines(spark, log_files(spark, sf))          # read order is enough: no numbering pass
    recs = extract(lines, CALLS_TEMPLATE, order_cols=["_block", "_mid"])
    return recs.select(normalize_time_text("Timestamp").alias("Timestamp"), "Hostname", "Total Calls")


@register("i3_template_no_eof", """
SELECT strftime(ts, '%m/%d/%Y %H:%M:%S') AS "Timestamp", 'cube' || CAST(user_id AS VARCHAR) AS "Hostname",
  printf('%.2f', value) AS "Total Calls" FROM events""")
def i3n(spark, sf):
    lines = raw_lines(spark, log_files(spark, sf))
    recs = extract(lines, CALLS_TEMPLATE + "\n\nEOF\n", order_cols=["_block", "_mid"])
    return recs.select(normalize_time_text("Timestamp").alias("Timestamp"), "Hostname", "Total Calls")


@register("i4_headings", """
SELECT s_suppkey AS "S Suppkey", s_name AS "S Name", s_nationkey AS "S Nationkey", s_acctbal AS "S Acctbal" FROM supplier""")
def i4(spark, sf):
    return normalize_headings(table(spark, sf, "supplier"))


_SQL_IP = r"(^|[^\pL\pN_])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})($|[^\pL\pN_])"


@register("i6_address_to_name", f"""
WITH hosts AS (SELECT DISTINCT ip, 'host-' || replace(ip, '.', '-') AS hostname
               FROM (SELECT unnest(regexp_extract_all(text, '{_SQL_IP}', 2)) AS ip FROM documents WHERE lang = 'en')),
f AS (SELECT doc_id, text, nullif(regexp_extract(text, '{_SQL_IP}', 2), '') AS ip FROM documents)
SELECT doc_id, CASE WHEN h.hostname IS NOT NULL THEN replace(f.text, f.ip, h.hostname) ELSE f.text END AS text
FROM f LEFT JOIN hosts h ON f.ip = h.ip""")
def i6(spark, sf):
    docs = table(spark, sf, "documents")
    hosts = (docs.where("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit(IPV4), 0)).alias("ip"))
             .distinct().select("ip", F.concat(F.lit("host-"), F.regexp_replace("ip", r"\.", "-")).alias("hostname")))
    return address_to_name(docs.select("doc_id", "text"), "text", hosts)


_SQL_BYTES = r"""
WITH types AS (SELECT DISTINCT event_type AS t FROM events),
h AS (SELECT user_id, 'HOST' || user_id AS host FROM events GROUP BY 1),
head AS (SELECT host, user_id, length('"(PDH-CSV 4.0) (UTC)(0)"') + sum(length(',"\\' || host || '\Events\' || t || '"')) + 1 AS b FROM h, types GROUP BY 1, 2),
body AS (SELECT user_id, sum(length('"01/01/2024 00:00:00.000"') + ((SELECT count(*) FROM types) - 1) * length('," "')
                             + length(',"' || printf('%.2f', value) || '"') + 1) AS b FROM events GROUP BY 1)
SELECT host, CAST(head.b + body.b AS BIGINT) AS filesize FROM head JOIN body USING (user_id)"""


def _per_host(inv):
    """Bytes per host folder (a host may have several files)."""
    return inv.groupBy(F.regexp_extract("system_path", r"host=([^/]+)/", 1).alias("host")).agg(F.sum("filesize").cast("bigint").alias("filesize"))


@register("i8_file_inventory", _SQL_BYTES)
def i8(spark, sf):
    return _per_host(inventory(spark, counter_files(spark, sf), name_parts=2))


@register("i8_refresh_inventory", _SQL_BYTES)
def i8r(spark, sf):
    # an older inventory knows half of the files, with sizes of before
    scanned = inventory(spark, counter_files(spark, sf), name_parts=2)
    older = scanned.where(F.pmod(F.xxhash64("filename"), F.lit(2)) == 0).withColumn("filesize", F.lit(0).cast("bigint"))
    return _per_host(refresh_inventory(older, scanned))


@register("i9_inventory_lookup", _SQL_BYTES + " WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def i9(spark, sf):
    # uploads asked for by the ids that charts of one group of hosts hold
    inv = inventory(spark, counter_files(spark, sf), name_parts=2).withColumn("id", F.xxhash64("filename"))
    host = F.regexp_extract("filename", r"host=HOST([^/]+)/", 1)
    asked = inv.join(building_hosts(spark, sf), host == F.col("host"), "left_semi").select("id")
    return _per_host(inventory_lookup(inv, asked))


# ---- templates of our own: end anchor, empty captures, Required with Clear, Continue with List, Fillup ----

_EVENT_TEXT = "printf('%.2f', value)"
_HOST = "'cube' || CAST(user_id AS VARCHAR)"


def _own(spark, sf, template: str):
    return extract(raw_lines(spark, log_files(spark, sf)), template, order_cols=["_block", "_mid"])


@register("i3_end_anchor", f"""
SELECT {_HOST} AS "Host", split_part({_EVENT_TEXT}, '.', 1) AS "Whole", split_part({_EVENT_TEXT}, '.', 2) AS "Cents" FROM events""")
def i3_anchor(spark, sf):
    return _own(spark, sf, r"""Value Filldown host (\S+)
Value Required whole (\d+)
Value cents (\d\d)

Start
  ^${host}#show calls$$
  ^Total Number of Active Calls : ${whole}\.${cents}$$ -> Record
""").select("Host", "Whole", "Cents")


@register("i3_empty_capture", f"""
SELECT {_HOST} AS "Host", regexp_extract(strftime(ts, '%g'), '^[5-9]*') AS "High" FROM events
WHERE CAST(split_part({_EVENT_TEXT}, '.', 1) AS INTEGER) % 2 = 0""")
def i3_empty(spark, sf):
    # the high digits of the milliseconds may be none; lines with an odd count make no record
    return _own(spark, sf, r"""Value Filldown host (\S+)
Value high ([5-9]*)

Start
  ^${host}#
  ^Query @ .*\.${high}
  ^Total .*[02468]\.\d\d$$ -> Record

EOF
""").select("Host", "High")


@register("i3_required_clear", f"""
SELECT {_HOST} AS "Host", strftime(ts, '%H:%M:%S') AS "Time", split_part({_EVENT_TEXT}, '.', 1) AS "Calls" FROM events
WHERE CAST(split_part({_EVENT_TEXT}, '.', 1) AS INTEGER) >= 10""")
def i3_required(spark, sf):
    return _own(spark, sf, r"""Value Filldown host (\S+)
Value time (\d+:\d+:\d+)
Value Required calls ([1-9]\d+)

Start
  ^${host}#
  ^Query @ \S+ ${time}
  ^Total Number of Active Calls : ${calls}\.\d\d$$ -> Record
  ^Total Number of Active Calls : 0 -> Clear
  ^Total -> Record
""").select("Host", "Time", "Calls")


@register("i3_continue_list", f"""SELECT {_HOST} AS "Host", replace({_EVENT_TEXT}, '.', ',') AS "Part" FROM events""")
def i3_list(spark, sf):
    out = _own(spark, sf, r"""Value Filldown host (\S+)
Value Required,List part (\d+)

Start
  ^${host}#
  ^Total Number of Active Calls : ${part}\. -> Continue
  ^Total .*\.${part}$$ -> Record
""")
    return out.select("Host", F.array_join("Part", ",").alias("Part"))


@register("i3_fillup", f"""
WITH d AS (SELECT *, CASE WHEN hour(ts) < 10 THEN strftime(ts, '%d') END AS d FROM events)
SELECT {_HOST} AS "Host", {_EVENT_TEXT} AS "Calls",
  coalesce(first_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS "Day" FROM d""")
def i3_fillup(spark, sf):
    # the day is seen only before ten o'clock; records without one take the next
    return _own(spark, sf, r"""Value Filldown host (\S+)
Value Fillup day (\d\d)
Value Required calls (\S+)

Start
  ^${host}#
  ^Query @ \d+-\d+-${day} 0
  ^Total Number of Active Calls : ${calls} -> Record
""").select("Host", "Calls", "Day")


# ---- templates with several states ----

def _states(hour: str, first_rules: str) -> str:
    """Calls lines count only behind a query line that leads to their state."""
    return rf"""Value Filldown host (\S+)
Value Required hour ({hour})
Value calls (\S+)

Start
  ^${{host}}#
{first_rules}

Calls
  ^Total Number of Active Calls : ${{calls}} -> Record Start
"""


@register("i3_states", f"""
SELECT {_HOST} AS "Host", strftime(ts, '%H') AS "Hour", {_EVENT_TEXT} AS "Calls" FROM events WHERE hour(ts) < 12""")
def i3_states(spark, sf):
    # the calls of the morning: other calls lines match no rule in the state Start
    return _own(spark, sf, _states(r"0\d|1[01]", r"  ^Query @ \S+ ${hour}: -> Calls")).select("Host", "Hour", "Calls")


@register("i3_state_end", f"""
WITH e AS (SELECT *, count(*) FILTER (hour(ts) = 23) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS late FROM events)
SELECT {_HOST} AS "Host", strftime(ts, '%H') AS "Hour", {_EVENT_TEXT} AS "Calls" FROM e WHERE late = 0""")
def i3_state_end(spark, sf):
    # a host's calls up to its first query after eleven at night
    rules = "  ^Query @ \\S+ 23: -> End\n  ^Query @ \\S+ ${hour}: -> Calls"
    return _own(spark, sf, _states(r"\d\d", rules)).select("Host", "Hour", "Calls")


@register("i3_state_errors", f"""
SELECT {_HOST} AS "Host", strftime(min(ts), '%d %H:%M') AS "Time", 'on the hour' AS message FROM events WHERE minute(ts) = 0 GROUP BY user_id""")
def i3_state_errors(spark, sf):
    rules = '  ^Query @ \\S+ \\d\\d:00 -> Error "on the hour"\n  ^Query @ \\S+ ${hour}: -> Calls'
    found = template_errors(raw_lines(spark, log_files(spark, sf)), _states(r"\d\d", rules), order_cols=["_block", "_mid"])
    return found.select(F.regexp_extract("file", r"host=([^/]+)/", 1).alias("Host"), F.regexp_extract("line", r"-(\d\d \d\d:\d\d)", 1).alias("Time"), "message")


@register("i5_time_losses", """
SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_unparsed,
  min(CASE WHEN event_type = 'error' THEN 'at ' || CAST(event_id AS VARCHAR) END) AS example FROM events""")
def i5_losses(spark, sf):
    # device clocks, log times and, for errors, text that is no time
    ev = table(spark, sf, "events")
    clock = F.date_format("ts", "H:mm:ss.SSS 'UTC' EEE MMM d yyyy")
    text = (F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("event_id").cast("string"))).when(F.col("event_type") == "view", clock)
            .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss.SSS")))
    return time_losses(ev.select(text.alias("t")), "t")


@register("i5_time_shapes", """
SELECT event_id, strftime(CASE event_id % 8 WHEN 5 THEN date_trunc('day', ts) WHEN 6 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END,
                          '%m/%d/%Y %H:%M:%S') AS t FROM events""")
def i5_shapes(spark, sf):
    ev = table(spark, sf, "events")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "M/d/yyyy h:mm:ss a", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "MMMM d, yyyy HH:mm:ss.SSSSSS", "EEE MMM d HH:mm:ss yyyy", "yyyyMMdd",
              "d-MMM-yyyy H:mm", "yyyy/MM/dd HH:mm:ss,SSS"]
    text = F.lit(None).cast("string")
    for i, f in enumerate(shapes):
        text = F.when(F.col("event_id") % len(shapes) == i, F.date_format("ts", f)).otherwise(text)
    return ev.select("event_id", normalize_time_text(text).alias("t"))


@register("i5_device_clock", "SELECT event_id, strftime(date_trunc('second', ts), '%m/%d/%Y %H:%M:%S') AS t FROM events")
def i5_clock(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", normalize_time_text(F.date_format("ts", "H:mm:ss.SSS 'UTC' EEE MMM d yyyy")).alias("t"))


@register("i7_stack", """
SELECT event_id, value AS click, NULL::DOUBLE AS view, NULL::DOUBLE AS signup FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, NULL, value, NULL FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, NULL, NULL, value FROM events WHERE event_type = 'signup'""")
def i7(spark, sf):
    # frames whose value columns differ, as files with different counters do
    ev = table(spark, sf, "events")
    return stack(ev.where(F.col("event_type") == t).select("event_id", F.col("value").alias(t)) for t in ("click", "view", "signup"))


@register("i1_counter_rejects", """
SELECT DISTINCT 'HOST' || CAST(user_id AS VARCHAR) AS host, 'counter not found: Events\\refund' AS reason FROM events""")
def i1r(spark, sf):
    # no file carries this counter: every file goes to the rejects frame
    _, rejects = read_counters(spark, counter_files(spark, sf), "Events\\refund")
    return rejects.select(F.regexp_extract("file", r"host=([^/]+)/", 1).alias("host"), "reason")
