"""Performance-counter CSVs (one per host) to long measurement rows.

Per file the header is its first record; it is found by aggregation (one row
per file) and joined back by file.  The wanted counter is the first header
cell that ends with the counter text; the host comes from the second header
cell (``\\\\HOST\\...``).  Files without the counter, or without a host in the
second cell, go to a rejects frame instead of failing the job; a record with
fewer cells has nulls.

A quoted cell may hold line breaks, so a line need not be a record.  Whether a
line starts inside a quoted cell depends on all lines before it: each line is a
function from (outside, inside) to (outside, inside), and a scan over functions
gives the place where every line stands, with one huge file in many tasks.
Only files in which some line leaves a cell open go through that scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.timefmt import parse_time
from hostlens.operators.function_scan import function_scan
from hostlens.operators.scan import keyed_scan
from hostlens.session import scratch_path
from hostlens.sources.lines import raw_lines
from hostlens.streaming.waiting import WaitingJoin

# CSV cells (quoted with doubled quotes, or bare) and the host pattern.
QUOTED = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'
CELL = rf'(?:"{QUOTED}|(?!")[^,]*+)'
HOST_PATTERN = r"^\\\\(.*?)\\"
OUTSIDE, INSIDE = 0, 1


def csv_cells(record: Column) -> Column:
    """Cells of one CSV record: quotes removed, doubled quotes undone; what follows a closing quote stays."""
    # every cell is taken with a comma before it, so that blank ones are cells too
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f'(?s),("{QUOTED}|[^,]*+)'), 1)
    quoted = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
    return F.transform(cells, lambda c: F.when(c.rlike(quoted), F.concat(
        F.regexp_replace(F.regexp_extract(c, quoted, 1), '""', '"'), F.regexp_extract(c, quoted, 2))).otherwise(c))


def leaves_open(line: Column) -> Column:
    """Whether a line that starts outside a quoted cell ends inside one."""
    return ~line.rlike(rf"(?s)^{CELL}(?:,{CELL})*+$")


def stays_inside(line: Column) -> Column:
    """Whether a line that starts inside a quoted cell ends inside one, be it another."""
    return ~line.rlike(rf"(?s)^{QUOTED}(?:,{CELL})*+$")


def csv_records(lines: DataFrame, file_col: str = "file", order: tuple[str, ...] = ("_block", "_mid"), line_col: str = "line") -> DataFrame:
    """Lines to records: (file, the order columns of a record's first line, line), a record's lines joined by line breaks.
    A cell that is still open at the end of its file is one more record."""
    line = F.col(line_col)
    step = F.array(leaves_open(line).cast("int"), stays_inside(line).cast("int"))
    placed = function_scan(lines.select(file_col, *order, line_col), file_col, list(order), step, states=2, start=OUTSIDE, before="_from", after="_to")
    starts = F.col("_from") == OUTSIDE
    # a record in one line is whole; the lines of the others are gathered, which is what a record is
    alone = placed.where(starts & (F.col("_to") == OUTSIDE)).select(file_col, *order, line_col)
    part = keyed_scan(placed.where(~starts | (F.col("_to") != OUTSIDE)), file_col, list(order), sums={"_record": starts.cast("int")})
    at = F.struct(*order)
    whole = (part.groupBy(file_col, "_record").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line")))).alias("_l"))
             .select(file_col, *[F.col("_l")[0]["at"][o].alias(o) for o in order], F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias(line_col)))
    return alone.unionByName(whole)


def _first_records(records: DataFrame) -> DataFrame:
    """(file, its first record's place and text, whether a line of it leaves a cell open), one row per file."""
    in_first = F.when(F.col("_block") == 0, F.col("_mid"))
    return records.groupBy("file").agg(F.min_by(F.struct("_mid", "line"), in_first).alias("_h"),
                                       F.coalesce(F.bool_or(leaves_open(F.col("line"))), F.lit(False)).alias("_open"))


def read_counters(spark: SparkSession, paths, counter: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (rows, rejects).

    rows:    file, pos, Timestamp (timestamp_ntz, null when unparsable),
             time_text, Hostname, <counter> (double, blank/bad/missing -> null)
    rejects: file, reason
    """
    lines = raw_lines(spark, paths, recursive)
    path = scratch_path(spark, "counter-files")
    first = _first_records(lines)
    first.write.parquet(path)           # one row per file
    first = spark.read.schema(first.schema).parquet(path)
    if first.where("_open").take(1):
        broken = first.where("_open").select("file")
        whole = csv_records(lines.join(broken, "file", "left_semi"))
        lines = lines.join(broken, "file", "left_anti").select("file", "_block", "_mid", "line").unionByName(whole)
        first = first.where("not _open").unionByName(_first_records(whole))
    return _measured(lines, first, counter)


def header_cells(first: DataFrame, counter: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per file the place of the counter's column (0: none) and the host ("": none)."""
    cells = csv_cells(F.col("_h.line"))
    return first.select(
        "file", *keep, F.col("_h._mid").alias("_hmid"),
        F.coalesce(F.array_position(F.transform(cells, lambda h: h.endswith(counter)), True), F.lit(0)).alias("_idx"),
        F.coalesce(F.regexp_extract(F.get(cells, F.lit(1)), HOST_PATTERN, 1), F.lit("")).alias("_host"))


def measurement(line: Column, counter: str) -> list[Column]:
    """(Timestamp, time_text, Hostname, counter) of a record, given ``_idx`` and ``_host`` of its file."""
    cells = csv_cells(line)
    t_text, raw_v = F.get(cells, F.lit(0)), F.get(cells, F.col("_idx").cast("int") - 1)
    return [parse_time(t_text).alias("Timestamp"), t_text.alias("time_text"), F.col("_host").alias("Hostname"),
            F.trim(raw_v).try_cast("double").alias(counter)]


def _measured(lines: DataFrame, first: DataFrame, counter: str) -> tuple[DataFrame, DataFrame]:
    hdr = header_cells(first, counter)
    good = (F.col("_idx") > 0) & (F.col("_host") != "")
    rejects = hdr.where(~good).select(
        "file", F.when(F.col("_idx") == 0, F.lit(f"counter not found: {counter}"))
        .otherwise(F.lit("no host in second header cell")).alias("reason"))
    # one row per file on the build side; AQE broadcasts it when it is small at run time
    body = lines.join(hdr.where(good), "file", "inner").where(
        ~((F.col("_block") == 0) & (F.col("_mid") == F.col("_hmid"))) & (F.trim("line") != ""))
    return body.select("file", F.struct("_block", "_mid").alias("pos"), *measurement(F.col("line"), counter)), rejects


def stack(frames) -> DataFrame:
    """Stack per-file frames whose columns differ (missing columns are null)."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def counter_stream(lines: DataFrame, counter: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I1 on a stream: (body, headers, rejects) of a frame of records (file, pos, seen, line), streaming or a batch of one, as
    files that grow arrive in pieces and in any order.  ``pos`` is a record's place in its file, 0 the header; ``seen`` a
    timestamp.  ``headers`` are those with the counter and a host; ``rejects`` are the others.
    """
    timed = lines.withColumn("seen", F.col("seen").cast("timestamp"))
    first = timed.where("pos = 0").select("file", F.col("seen").alias("_hseen"), F.struct(F.col("pos").alias("_mid"), "line").alias("_h"))
    hdr = header_cells(first, counter, ("_hseen",))
    good = (F.col("_idx") > 0) & (F.col("_host") != "")
    rejects = hdr.where(~good).select("file", F.when(F.col("_idx") == 0, F.lit(f"counter not found: {counter}"))
                                      .otherwise(F.lit("no host in second header cell")).alias("reason"))
    return timed.where((F.col("pos") > 0) & (F.trim("line") != "")), hdr.where(good).select("file", "_hseen", "_idx", "_host"), rejects


def stream_counters(spark: SparkSession, source_dir: str, counter: str, delay: str, sink_dir: str, checkpoint_dir: str, salts: int = 8) -> None:
    """Run I1 over a folder of parquet pieces (file, pos, seen, line) for everything available now;
    rows go to ``sink_dir``/rows and rejects to ``sink_dir``/rejects.  Started again with the same checkpoint, it goes on;
    a checkpoint whose waiting rows are in a state store is refused.

    Headers and bodies meet in a join of the stream's two sides: a header is kept for the bodies to come and a body that is
    earlier than its header waits, both within ``delay`` of ``seen``, which is the watermark that clears what waits.  The
    rows of one file are spread over ``salts`` keys.  Rows are those of ``read_counters``.
    """
    schema = "file string, pos long, seen timestamp, line string"
    pieces = lambda: spark.readStream.schema(schema).parquet(source_dir)
    body, headers, rejects = counter_stream(pieces(), counter)
    join = WaitingJoin(spark, f"{checkpoint_dir}/waiting", body.schema, headers.schema, key="file", left_time="seen", right_time="_hseen",
                       delay=delay, spread="pos", salts=salts)
    if join.exists(f"{checkpoint_dir}/rows/state"):
        raise ValueError(f"the waiting rows of {checkpoint_dir} are in a state store, which is not read")
    (pieces().writeStream.foreachBatch(lambda df, i: join.append(i, *counter_stream(df, counter)[:2]) and None)
     .option("checkpointLocation", f"{checkpoint_dir}/met").trigger(availableNow=True).start().awaitTermination())
    join.publish()
    met = spark.readStream.schema(join.schema).option("recursiveFileLookup", "true").option("cleanSource", "delete").parquet(join.met)
    for name, out in (("rows", met.select("file", "pos", *measurement(F.col("line"), counter))), ("rejects", rejects)):
        (out.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint_dir}/{name}").outputMode("append")
         .trigger(availableNow=True).start(f"{sink_dir}/{name}").awaitTermination())
