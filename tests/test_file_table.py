"""Copy on write by file: the kernels' results, the files touched, counts, two writers."""

import random

from pyspark.sql import functions as F

from hostlens.operators import kernels as K
from hostlens.operators.file_table import FileTable
from hostlens.session import scratch_path

SCHEMA = "k long, a string, n int"


def _table(spark, n=1000, file_rows=100):
    rows = spark.createDataFrame([(2 * i, f"a{i}", i % 7) for i in range(n)], SCHEMA)
    t = FileTable(spark, scratch_path(spark, "file-table"), "k", file_rows=file_rows)
    t.create(rows)
    return t, rows


def _rows(df):
    return sorted((tuple(r) for r in df.select("k", "a", "n").collect()), key=repr)


def _paths(t):
    return {r.path for r in t.manifest().collect()}


def test_kernels_on_files(spark):
    t, rows = _table(spark)
    assert _rows(t.read()) == _rows(rows) and len(_paths(t)) == 10
    rng = random.Random(3)
    state = rows
    before = _paths(t)
    # keys of two files, of them some new
    up = spark.createDataFrame([(k, f"new{k}", None) for k in (10, 11, 12, 405, 406, 407)] + [(-5, "low", 1), (None, "no key", 1)], SCHEMA)
    want = K.upsert(state, up.where("k is not null"), "k")
    assert t.upsert(up) == {"n_inserted": 4, "n_deleted": 0, "n_updated": 3}
    assert _rows(t.read()) == _rows(want)
    assert len(before - _paths(t)) == 2 and len(before & _paths(t)) == 8        # the others are listed again
    state = spark.createDataFrame(want.collect(), SCHEMA)
    ch = spark.createDataFrame([(12, None, True, 5, True), (1998, "x", True, None, False), (7777, "gone", True, 1, True), (14, "a7", True, 0, True)],
                               "k long, a string, _set_a boolean, n int, _set_n boolean")
    want = K.update(state, ch, "k", ["a", "n"])
    assert t.update(ch, ["a", "n"]) == {"n_inserted": 0, "n_deleted": 0, "n_updated": 2}
    assert _rows(t.read()) == _rows(want)
    state = spark.createDataFrame(want.collect(), SCHEMA)
    keys = spark.createDataFrame([(k,) for k in [*range(200, 400), 1, 12]], "k long")
    assert t.delete(keys) == {"n_inserted": 0, "n_deleted": 101, "n_updated": 0}
    assert _rows(t.read()) == _rows(K.delete(state, keys, "k"))
    # the range of a file whose rows are all gone goes to the file before it
    assert t.upsert(spark.createDataFrame([(300, "back", 1)], SCHEMA))["n_inserted"] == 1
    assert t.read().where("k = 300").first().a == "back"
    last = t.version()
    assert t.delete(spark.createDataFrame([(301,)], "k long")) == {"n_inserted": 0, "n_deleted": 0, "n_updated": 0} and t.version() == last
    assert _rows(t.read(1)) == _rows(rows)           # earlier versions stay
    assert t.append(spark.createDataFrame([("z1", 1), ("z2", 2)], "a string, n int"), ["a"]) == 2
    assert [(r.k, r.a) for r in t.read().where("k > 1998").orderBy("k").collect()] == [(1999, "z1"), (2000, "z2")]
    ranges = sorted((r.lo, r.hi) for r in t.manifest().collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_two_writers_lose_no_change(spark):
    t, rows = _table(spark, n=60, file_rows=20)
    other = FileTable(spark, t.root, "k", file_rows=20)
    owners, turns = t.owners, []

    def meanwhile(*args):
        if not turns:
            turns.append(other.delete(spark.createDataFrame([(0,), (2,)], "k long")))
        return owners(*args)

    t.owners = meanwhile
    assert t.upsert(spark.createDataFrame([(4, "mine", 1)], SCHEMA)) == {"n_inserted": 0, "n_deleted": 0, "n_updated": 1}
    got = {r.k: r.a for r in t.read().collect()}
    assert 0 not in got and 2 not in got and got[4] == "mine" and len(got) == 58 and t.version() == 3
