"""The stream join whose waiting rows are in files, and reading many small files."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from hostlens.session import scratch_path
from hostlens.sources import counters, lines
from hostlens.streaming import waiting
from hostlens.streaming.waiting import WaitingJoin
from tests.conftest import small_slices

BODY, HEAD = "file string, pos long, seen timestamp, line string", "file string, _hseen timestamp, _host string"


def _join(spark, root=None, **more):
    body, head = (spark.createDataFrame([], s).schema for s in (BODY, HEAD))
    return WaitingJoin(spark, root or scratch_path(spark, "waiting"), body, head, key="file", left_time="seen", right_time="_hseen", delay="10 minutes", spread="pos", **more)


def _frames(spark, bodies, heads):
    at = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    return (spark.createDataFrame(bodies, "file string, pos long, seen double").select("file", "pos", at("seen"), F.concat(F.lit("line "), F.col("pos").cast("string")).alias("line")),
            spark.createDataFrame(heads, "file string, _hseen double, _host string").select("file", at("_hseen"), "_host"))


def _met(spark, join):
    got = spark.read.schema(join.schema).option("recursiveFileLookup", "true").parquet(join.met)
    return sorted((r.file, r.pos, r._host) for r in got.collect())


def _brute(batches, wait=600.0):
    """Every pair of rows that were not late when they came."""
    lefts, rights, ltop, rtop = [], [], 0, 0
    for bodies, heads in batches:
        mark = max(0, min(ltop, rtop) - wait)
        lefts += [b for b in bodies if None not in b and b[2] > mark]
        rights += [h for h in heads if None not in h and h[1] > mark]
        ltop, rtop = max((b[2] for b in lefts), default=0), max((h[1] for h in rights), default=0)
    return sorted((b[0], b[1], h[2]) for b in lefts for h in rights if b[0] == h[0] and abs(b[2] - h[1]) <= wait)


def test_batches_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    batches, clock = [], 1000.0
    for i in range(5):
        clock += 300 * i        # some rows are late, and early batches can meet nothing more
        when = lambda: rng.choice([None, 5.0, *[clock + rng.randrange(-900, 400)] * 8])  # noqa: E731, B023
        file = lambda: rng.choice([None, *"abcd"])
        batches.append(([(file(), rng.randrange(9), when()) for _ in range(40)], [(file(), when(), f"H{rng.randrange(3)}") for _ in range(0 if i == 0 else 7)]))
    want = _brute(batches)
    assert want and len(want) != len(_brute(batches, 1e9))
    for few in (0, waiting.BROADCAST_ROWS):
        monkeypatch.setattr(waiting, "BROADCAST_ROWS", few)
        join = _join(spark)
        with small_slices(spark, 50):
            for i, (bodies, heads) in enumerate(batches):
                assert join.append(i, *_frames(spark, bodies, heads))
                assert join.append(i, *_frames(spark, bodies, heads)) is False      # replayed
        assert _met(spark, join) == want
        left = os.listdir(f"{join.root}/left")
        assert 0 < len(left) < 5 and not any(x.startswith("0-") for x in left)      # what cannot meet later rows is deleted


def test_a_stop_between_commit_and_publishing(spark, monkeypatch):
    join = _join(spark)
    with monkeypatch.context() as m:
        m.setattr(WaitingJoin, "publish", lambda self: None)
        assert join.append(0, *_frames(spark, [("a", 1, 100.0)], [("a", 101.0, "A")]))
    assert _met(spark, join) == []
    again = _join(spark, join.root)
    assert again.append(0, *_frames(spark, [("a", 1, 100.0)], [("a", 101.0, "A")])) is False
    assert _met(spark, again) == [("a", 1, "A")]
    # an attempt that did not commit leaves nothing that is read
    with monkeypatch.context() as m:
        m.setattr(again._log, "claim", lambda *_: False)
        assert again.append(1, *_frames(spark, [("a", 2, 100.0)], [])) is False
    assert again.append(1, *_frames(spark, [("a", 2, 100.0)], []))
    assert _met(spark, again) == [("a", 1, "A"), ("a", 2, "A")]


def test_waiting_lines_are_not_in_a_state_store(spark, monkeypatch):
    monkeypatch.setattr(waiting, "BROADCAST_ROWS", 0)
    src, sink, ckpt = (scratch_path(spark, x) for x in ("pieces", "sink", "ckpt"))
    pieces = [(f"f{i}", j, '"(PDH)","\\\\H{}\\Load"'.format(i) if j == 0 else f'"01/01/2024 00:00:{j:02d}",{j}') for i in range(5) for j in range(20)]
    pieces += [("f0", 0, pieces[0][2])]         # a header that comes twice meets each line twice
    df = spark.createDataFrame(pieces, "file string, pos long, line string").select("file", "pos", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("seen"), "line")
    for part, n in ((df.where("pos > 5"), 0), (df.where("pos <= 5"), 114), (df.where("pos > 18"), 120)):
        part.write.mode("append").parquet(src)
        counters.stream_counters(spark, src, "Load", "1 hour", sink, ckpt)
        assert spark.read.parquet(f"{sink}/rows").count() == n
    assert not any("state" in d for _, dirs, _ in os.walk(ckpt) for d in dirs)
    os.makedirs(f"{ckpt}/rows/state")
    try:
        counters.stream_counters(spark, src, "Load", "1 hour", sink, ckpt)
        raise AssertionError("not refused")
    except ValueError as e:
        assert "state store" in str(e)


def test_many_small_files_in_few_tasks(spark):
    d = tempfile.mkdtemp(prefix="hl-small-")
    for i in range(150):
        os.makedirs(f"{d}/host={i}")
        with open(f"{d}/host={i}/part.txt", "w") as f:
            f.writelines(f"{i} {j}\n" for j in range(3))
    cost, listing = "spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old, tasks = spark.conf.get(cost), spark.conf.get(listing)
    spark.conf.set(cost, "128m")        # a task per file, but for the bound
    try:
        df = lines.raw_lines(spark, d)
        assert df.rdd.getNumPartitions() <= lines.CORE_TASKS * spark.sparkContext.defaultParallelism < 150
        assert df.agg(F.count_distinct("_mid")).first()[0] == 450
        got = {(r.line, r.line_no) for r in lines.read_lines(spark, d).collect()}
        assert got == {(f"{i} {j}", j) for i in range(150) for j in range(3)}
    finally:
        spark.conf.set(cost, old)
    assert spark.conf.get(listing) == tasks
