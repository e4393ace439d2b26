"""Row identity with nulls, numbered commits, concurrent publishing."""

import threading

import pytest
from pyspark.sql import functions as F

from hostlens.functions.identity import row_hash, row_key
from hostlens.operators import kernels as K
from hostlens.operators.commits import CommitLog, Conflict
from hostlens.session import scratch_path


def test_hash_tells_null_places_apart(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', null, array(null, 'x'), map('k', 1)), (null, 'a', array(null, 'x'), map('k', 1)),
                      ('a', null, array('x', null), map('k', 1)), ('a', null, array(null, 'x'), map('k', 2)), ('a', null, array(null, 'x'), map('k', 1)),
                      (null, null, null, null), (null, null, null, map('k', cast(null as int))) AS t(p, q, r, s)""")
    assert df.select(row_hash(df).alias("h")).distinct().count() == 6
    assert df.select(row_key(df).alias("h")).distinct().count() == 6
    assert df.select(row_key(df, ["p", "q"]).alias("h")).distinct().count() == 3
    nested = spark.sql("SELECT named_struct('x', 'a', 'y', cast(null as string)) AS s UNION ALL SELECT named_struct('x', null, 'y', 'a')")
    assert nested.select(row_hash(nested).alias("h")).distinct().count() == 2


def test_affected_counts_moved_values_and_null_keys(spark):
    schema = "k int, a string, b string"
    before = spark.createDataFrame([(1, "x", None), (2, "y", None), (None, "z", None), (4, "w", None)], schema)
    after = spark.createDataFrame([(1, None, "x"), (2, "y", None), (None, "z", None), (5, "w", None)], schema)
    assert tuple(K.affected(before, after, "k").first()) == (1, 1, 1)
    changed = after.withColumn("a", F.when(F.col("k").isNull(), "q").otherwise(F.col("a")))
    assert tuple(K.affected(after, changed, "k").first()) == (0, 0, 1)


def test_one_writer_gets_a_number(spark):
    log = CommitLog(spark, scratch_path(spark, "log"))
    assert log.last() == (0, None) and log.entries() == []
    won, start = [], threading.Barrier(8)

    def write(i):
        mine = CommitLog(spark, log.folder)
        start.wait()
        for number in range(1, 6):
            if mine.claim(number, f"writer-{i}-{number}"):
                won.append((number, i))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in won) == [1, 2, 3, 4, 5]
    assert log.entries() == [f"writer-{i}-{n}" for n, i in sorted(won)]


def test_publish_after_another_writer(spark):
    root = scratch_path(spark, "versions")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    K.publish(spark, row(1, "a"), root, "t")
    seen = K.current_number(spark, root, "t")
    K.publish(spark, row(1, "b"), root, "t", after=seen)
    with pytest.raises(Conflict):
        K.publish(spark, row(1, "c"), root, "t", after=seen)
    assert [tuple(r) for r in K.current(spark, root, "t").collect()] == [(1, "b")]


def test_transactions_lose_no_change(spark):
    """Two writers read the same version; the second one's change is made again from the first one's."""
    root = scratch_path(spark, "versions")
    K.publish(spark, spark.createDataFrame([(0, "x")], "k int, v string"), root, "t")
    turns = []

    def add(k, meanwhile=None):
        def change(state):
            if meanwhile and not turns:
                turns.append(meanwhile())
            return K.upsert(state, spark.createDataFrame([(k, "x")], "k int, v string"), "k")
        return K.transact(spark, root, "t", change)

    add(1, meanwhile=lambda: add(2))
    assert sorted(r.k for r in K.current(spark, root, "t").collect()) == [0, 1, 2]
    assert K.current_number(spark, root, "t") == 3
