"""Render driver tables as the raw inputs the reference ingests (F1, F2).

These writers build test inputs from ``events`` so that ingestion can be
checked against the table it came from.  One file per host is the format of
the inputs, so each host's lines are written by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.operators.scan import slice_count
from hostlens.operators.series import pivot_values
from hostlens.sources.sinks import write_lines_per_host

# The performance-counter CSV header cell and the log line shapes.
PDH_FIRST_HEADER = "(PDH-CSV 4.0) (UTC)(0)"
LOG_QUERY_LINE = "Query @ {}"
LOG_HOST_LINE = "{}#show calls"
LOG_CALLS_LINE = "Total Number of Active Calls : {}"


def _q(c):
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))


def render_counter_csv(events: DataFrame, out: str, counters=None) -> str:
    """one CSV per host; header ``"(PDH...)","\\\\HOST<h>\\Events\\<type>",...``;
    the cell of the event's type holds its value, the others a blank ``" "``."""
    counters = counters or pivot_values(events, "event_type")
    host = F.concat(F.lit("HOST"), F.col("user_id").cast("string"))
    header_cells = [_q(F.lit(PDH_FIRST_HEADER))] + [
        _q(F.concat(F.lit("\\\\"), host, F.lit("\\Events\\" + c))) for c in counters]
    data_cells = [_q(F.date_format("ts", "MM/dd/yyyy HH:mm:ss.SSS"))] + [
        _q(F.when(F.col("event_type") == c, F.format_string("%.2f", F.col("value"))).otherwise(F.lit(" ")))
        for c in counters]
    hosts = events.select(host.alias("host"), F.col("user_id")).distinct()
    head = hosts.select("host", F.lit(-1).cast("long").alias("_o"), F.lit(None).cast("timestamp_ntz").alias("_t"),
                        F.concat_ws(",", *[c for c in header_cells]).alias("value"))
    body = events.select(host.alias("host"), F.col("event_id").alias("_o"), F.col("ts").alias("_t"),
                         F.concat_ws(",", *data_cells).alias("value"))
    lines = head.unionByName(body)
    return write_lines_per_host(lines, ["_t", "_o"], out, slice_count(events))


def render_device_log(events: DataFrame, out: str) -> str:
    """one log per host: the host prompt once, then per event a query line
    (time) and a calls line (value)."""
    host = F.concat(F.lit("cube"), F.col("user_id").cast("string"))
    hosts = events.select(host.alias("host")).distinct()
    first = hosts.select("host", F.lit(None).cast("timestamp_ntz").alias("_t"), F.lit(-1).cast("long").alias("_o"),
                         F.lit(0).alias("_k"), F.format_string(LOG_HOST_LINE.replace("{}", "%s"), "host").alias("value"))
    q = events.select(host.alias("host"), F.col("ts").alias("_t"), F.col("event_id").alias("_o"), F.lit(1).alias("_k"),
                      F.format_string(LOG_QUERY_LINE.replace("{}", "%s"),
                                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("value"))
    c = events.select(host.alias("host"), F.col("ts").alias("_t"), F.col("event_id").alias("_o"), F.lit(2).alias("_k"),
                      F.format_string(LOG_CALLS_LINE.replace("{}", "%s"),
                                      F.format_string("%.2f", F.col("value"))).alias("value"))
    lines = first.unionByName(q).unionByName(c)
    return write_lines_per_host(lines, ["_t", "_o", "_k"], out, slice_count(events))


def render_document_csv(docs: DataFrame, out: str, parts: int = 4) -> str:
    """Documents as counter CSVs: ``doc_id``, ``n_chars`` and the quoted text with its line breaks; one
    file per source and remainder of the id, each with a header.  Every third line is cut behind the id."""
    host = F.concat(F.lit("DOCS-"), F.coalesce("source", F.lit("none")))
    part = F.pmod(F.col("doc_id"), F.lit(parts))
    head = F.concat_ws(",", _q(F.lit(PDH_FIRST_HEADER)), *[_q(F.concat(F.lit("\\\\"), F.col("host"), F.lit(f"\\Texts\\{c}"))) for c in ("chars", "text")])
    body = docs.select(host.alias("host"), part.alias("part"), F.col("doc_id").alias("_o"), F.when(F.col("doc_id") % 3 == 0, _q(F.col("doc_id").cast("string"))).otherwise(
        F.concat_ws(",", _q(F.col("doc_id").cast("string")), F.col("n_chars").cast("string"), _q(F.coalesce("text", F.lit(""))))).alias("value"))
    heads = body.select("host", "part").distinct().select("host", "part", F.lit(None).cast("long").alias("_o"), head.alias("value"))
    (heads.unionByName(body).repartition("host", "part").sortWithinPartitions("host", "part", F.col("_o").asc_nulls_first())
     .select("host", "part", "value").write.mode("errorifexists").partitionBy("host", "part").text(out))
    return out
