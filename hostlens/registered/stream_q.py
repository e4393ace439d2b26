"""Registered S1 (batch and stream) and streaming Q9 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.timefmt import normalize_time_text
from hostlens.registered.ingest_q import COUNTER, counter_files
from hostlens.session import scratch_path
from hostlens.sources.counters import stream_counters
from hostlens.sources.lines import read_lines
from hostlens.streaming.running import RunningTable
from hostlens.streaming.tail import stream_time_buckets, tail_after, tail_cursor, tail_stream
from hostlens.registry import r6, register, sql_ts, table, ts_text

SEEN_UNTIL = "2024-01-15 00:00:00"


def _log(spark, sf):
    """F8: events as an import log (pkid, Time, Level, Message)."""
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("pkid"), F.col("ts").alias("Time"),
                     F.col("event_type").alias("Level"), F.col("props").alias("Message"))


def _cursor(spark, sf):
    """The last key already shown: the newest row before a point in time (one value)."""
    return (table(spark, sf, "events").where(F.col("ts") < F.lit(SEEN_UNTIL).cast("timestamp_ntz"))
            .agg(F.max("event_id")).first()[0])


_SQL_TAIL = f"""
SELECT event_id AS pkid, {sql_ts('ts')} AS "Time", event_type AS "Level", props AS "Message",
  (SELECT max(event_id) FROM events) AS next_cursor FROM events
WHERE event_id > (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '{SEEN_UNTIL}')"""


@register("s1_log_tail_batch", _SQL_TAIL)
def s1(spark, sf):
    out = tail_after(_log(spark, sf), "pkid", _cursor(spark, sf))
    return out.withColumn("Time", ts_text("Time"))


@register("s1_log_cursor", """
SELECT 'new rows' AS seen, max(event_id) AS next_cursor FROM events UNION ALL SELECT 'no new row', max(event_id) FROM events""")
def s1c(spark, sf):
    # the cursor is told also when no row is new
    log = _log(spark, sf)
    last = log.agg(F.max("pkid")).first()[0]
    return (tail_cursor(log, "pkid", _cursor(spark, sf)).select(F.lit("new rows").alias("seen"), "next_cursor")
            .unionByName(tail_cursor(log, "pkid", last).select(F.lit("no new row").alias("seen"), "next_cursor")))


@register("s1_log_tail_stream", _SQL_TAIL.replace(",\n  (SELECT max(event_id) FROM events) AS next_cursor", ""))
def s1s(spark, sf):
    log = _log(spark, sf)
    src = scratch_path(spark, "log-source")
    log.write.mode("errorifexists").parquet(src)
    sink = scratch_path(spark, "log-sink")
    tail_stream(spark, src, log.schema, "pkid", _cursor(spark, sf), sink, scratch_path(spark, "log-ckpt"))
    return spark.read.parquet(sink).withColumn("Time", ts_text("Time"))


@register("s1_running_positions", """
SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS "Hostname", row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS x,
  last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events""")
def s1_positions(spark, sf):
    # the log in three batches, each numbered on its own and each sent twice
    ev = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("Hostname"),
                                           F.when(F.col("event_type") == "view", F.col("value")).alias("seen"))
    top = ev.agg(F.max("pos")).first()[0]
    log = RunningTable(spark, scratch_path(spark, "running"), ev.schema, "Hostname", ["pos"], name="x", fills=["seen"])
    for i in range(3):
        for _ in range(2):
            log.append(f"part-{i}", ev.where((F.col("pos") >= i * (top + 3) // 3) & (F.col("pos") < (i + 1) * (top + 3) // 3)))
    return log.rows()


@register("i1_counter_stream", """
SELECT strftime(ts, '%m/%d/%Y %H:%M:%S') AS "Timestamp", 'HOST' || CAST(user_id AS VARCHAR) AS "Hostname",
  CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS "Events\\purchase" FROM events""")
def i1_stream(spark, sf):
    # the counter files in pieces, later lines first, over a restart
    lines = read_lines(spark, counter_files(spark, sf)).select("file", F.col("line_no").alias("pos"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("seen"), "line")
    src, sink, ckpt = (scratch_path(spark, x) for x in ("counter-pieces", "counter-sink", "counter-ckpt"))
    for part in (lines.where("pos > 20"), lines.where("pos <= 20")):
        part.write.mode("append").parquet(src)
        stream_counters(spark, src, COUNTER, "1 hour", sink, ckpt)
    return spark.read.parquet(f"{sink}/rows").select(normalize_time_text("time_text").alias("Timestamp"), "Hostname", F.col(f"`{COUNTER}`"))


DELAY_HOURS = 2


@register("q9_stream_time_buckets", f"""
SELECT CAST(user_id AS VARCHAR) AS "Hostname", {sql_ts('make_timestamp(epoch_us(ts) // 3600000000 * 3600000000)')} AS bucket_start,
  count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events
GROUP BY 1, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000)
HAVING make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) + INTERVAL 1 HOUR
       <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_HOURS} HOUR""")
def q9s(spark, sf):
    ev = table(spark, sf, "events").select(F.col("ts").alias("Timestamp"),
                                           F.col("user_id").cast("string").alias("Hostname"),
                                           F.col("value").alias("Value"))
    src = scratch_path(spark, "events-source")
    ev.write.mode("errorifexists").parquet(src)
    sink = scratch_path(spark, "buckets-sink")
    stream_time_buckets(spark, src, ev.schema, time_col="Timestamp", host_col="Hostname", value_col="Value",
                        seconds=3600, delay=f"{DELAY_HOURS} hours", sink_dir=sink,
                        checkpoint_dir=scratch_path(spark, "buckets-ckpt"))
    out = spark.read.parquet(sink)
    return out.select("Hostname", ts_text("bucket_start").alias("bucket_start"), "n",
                      r6("mean_value").alias("mean_value"), "max_value")


@register("q9_stream_all_aggregations", f"""
SELECT CAST(user_id AS VARCHAR) AS "Hostname", {sql_ts('make_timestamp(epoch_us(ts) // 3600000000 * 3600000000)')} AS bucket_start,
  count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value, min(value) AS min_value,
  min_by(value, epoch_us(ts)::HUGEINT * 100000000000 + event_id) AS first_value, max_by(value, epoch_us(ts)::HUGEINT * 100000000000 + event_id) AS last_value FROM events
GROUP BY 1, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000)
HAVING make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) + INTERVAL 1 HOUR
       <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_HOURS} HOUR""")
def q9s_all(spark, sf):
    ev = table(spark, sf, "events").select(F.col("ts").alias("Timestamp"), F.col("user_id").cast("string").alias("Hostname"),
                                           F.col("value").alias("Value"), F.col("event_id").alias("pos"))
    src, sink = scratch_path(spark, "events-source"), scratch_path(spark, "buckets-sink")
    ev.write.mode("errorifexists").parquet(src)
    stream_time_buckets(spark, src, ev.schema, time_col="Timestamp", host_col="Hostname", value_col="Value", pos_col="pos", seconds=3600,
                        delay=f"{DELAY_HOURS} hours", sink_dir=sink, checkpoint_dir=scratch_path(spark, "buckets-ckpt"))
    out = spark.read.parquet(sink)
    return out.select("Hostname", ts_text("bucket_start").alias("bucket_start"), "n", r6("mean_value").alias("mean_value"), "max_value", "min_value", "first_value", "last_value")
