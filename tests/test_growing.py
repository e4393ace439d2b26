"""Growing tables: positions batch by batch, counter files that arrive in pieces."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from hostlens.operators.scan import keyed_scan, ordinal
from hostlens.session import scratch_path
from hostlens.sources.counters import read_counters, stream_counters
from hostlens.streaming.running import RunningTable, stream_positions
from tests.conftest import SMALL


def _events(spark):
    host = F.when(F.col("event_type") == "click", F.lit(None)).when(F.col("event_type") == "view", "hot").otherwise(F.col("user_id").cast("string"))
    return spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", host.alias("host"), F.when(F.col("value") > 40, F.col("value")).alias("cap"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_give_the_table_of_one_run(spark):
    ev = _events(spark)
    want = _rows(keyed_scan(ordinal(ev, "host", ["event_id"], name="rn"), "host", ["event_id"], fills={"f": "cap"}).select("event_id", "host", F.col("f").alias("cap"), "rn"))
    table = RunningTable(spark, scratch_path(spark, "running"), ev.schema, "host", ["event_id"], fills=["cap"], fold=3)
    cuts = [0, 100, 101, 101, 600, 10_000]       # one batch of one row, one of none
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = ev.where((F.col("event_id") >= a) & (F.col("event_id") < b))
        assert table.append(f"b{i}", part)
        assert table.append(f"b{i}", part) is False         # replayed
    assert _rows(table.rows()) == want
    assert table.committed() == [f"b{i}" for i in range(len(cuts) - 1)]
    n = {r.host: r.n for r in table.carry().collect()}
    assert n == {r.host: r["count"] for r in ev.groupBy("host").count().collect()}
    # a new reader, and a batch that a stopped writer left half done
    again = RunningTable(spark, table.root, ev.schema, "host", ["event_id"], fills=["cap"], fold=3)
    again._write("b9@left-behind", ev.limit(5), again._log.entries(), False)
    assert _rows(again.rows()) == want


def test_interleaved_appends(spark):
    ev = _events(spark).where("host = 'hot'")
    root = scratch_path(spark, "running")
    one, two = (RunningTable(spark, root, ev.schema, "host", ["event_id"]) for _ in range(2))
    write, turns = one._write, []

    def meanwhile(*args):
        write(*args)
        if not turns:
            turns.append(two.append("first", ev.where("event_id < 300")))

    one._write = meanwhile
    assert one.append("second", ev.where("event_id >= 300"))
    assert _rows(one.rows().select("event_id", "rn")) == _rows(ordinal(ev, "host", ["event_id"]).select("event_id", "rn"))


def test_positions_on_a_stream(spark):
    ev = _events(spark)
    src, root, ckpt = (scratch_path(spark, x) for x in ("pieces", "running", "ckpt"))
    table = RunningTable(spark, root, ev.schema, "host", ["event_id"])
    for lo, hi in ((0, 400), (400, 10_000)):
        ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).write.mode("append").parquet(src)
        stream_positions(table, spark.readStream.schema(ev.schema).parquet(src), ckpt)
    assert _rows(table.rows().select("event_id", "rn")) == _rows(ordinal(ev, "host", ["event_id"]).select("event_id", "rn"))


def test_counter_files_in_pieces_and_over_a_restart(spark):
    """Pieces in random order, headers after their bodies, a stop between: the batch result."""
    rng = random.Random(6)
    d = tempfile.mkdtemp(prefix="hl-i1s-")
    files = {f"h{i}.csv": [f'"(PDH)","\\\\H{i}\\{"Load" if i != 2 else "Other"}"'] + [f'"01/01/2024 00:{j // 60:02d}:{j % 60:02d}",{j if j % 9 else " "}' for j in range(40 + 60 * i)]
             for i in range(4)} | {"none.csv": ["nothing", "1,2"]}
    for f, ls in files.items():
        with open(os.path.join(d, f), "w") as out:
            out.write("\n".join(ls) + "\n")
    want, rejects = read_counters(spark, d, "Load")
    want = _rows(want.select(F.regexp_extract("file", "[^/]+$", 0), "Timestamp", "time_text", "Hostname", "Load"))
    pieces = [(f, j, f"2024-01-01 00:00:{rng.randrange(60):02d}", line) for f, ls in files.items() for j, line in enumerate(ls)]
    rng.shuffle(pieces)
    src, sink, ckpt = (scratch_path(spark, x) for x in ("pieces", "sink", "ckpt"))
    for part in (pieces[:200], pieces[200:]):
        df = spark.createDataFrame(part, "file string, pos long, seen string, line string").withColumn("seen", F.col("seen").cast("timestamp"))
        df.repartition(3).write.mode("append").parquet(src)
        stream_counters(spark, src, "Load", "10 minutes", sink, ckpt)
    got = spark.read.parquet(f"{sink}/rows")
    assert _rows(got.select("file", "Timestamp", "time_text", "Hostname", "Load")) == want
    back = {(os.path.basename(r.file), r.reason) for r in rejects.collect()}
    assert {(r.file, r.reason) for r in spark.read.parquet(f"{sink}/rejects").collect()} == back
