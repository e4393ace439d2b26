"""Rows that differ only in where their nulls stand are different rows, in all operators that tell rows apart."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm import exact_dedup, simhash, token_counts
from hostlens.session import scratch_path
from tests.llm.helpers import DOCS

FOUR = [(1, "alpha", None, None), (1, None, "alpha", None), (2, "beta gamma", None, "x"), (2, "beta gamma", "x", None)]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nulls_in_other_places(spark):
    docs = spark.createDataFrame(FOUR, DOCS)
    for drop in (exact_dedup.drop_copies, simhash.drop_near_duplicates):
        got = _rows(drop(docs))
        # the null text and the two different texts; of the two rows with one id and text, one
        assert [r[:2] for r in got] == [(1, "alpha"), (1, None), (2, "beta gamma")]
        assert all(r in FOUR for r in got)


def test_nulls_in_token_counts(spark):
    docs = spark.createDataFrame(FOUR, DOCS)
    key = token_counts.row_key(*[F.col(c) for c in ("doc_id", "text", "source", "lang")])
    store = token_counts.RollupStore(spark, scratch_path(spark, "rollup-nulls"))
    store.commit("load", token_counts.changes(docs.withColumn("row_key", key), "insert", {"words": token_counts.word_count}, key_col="row_key"))
    assert _rows(store.totals().select("source", "lang", "docs", "tokens")) == sorted(
        [(None, None, 1, 1), (None, "alpha", 1, 0), ("x", None, 1, 2), (None, "x", 1, 2)], key=repr)


def test_random_frames_with_nulls(spark):
    """Kept rows are a choice of one row per text; every text keeps one; nothing else goes."""
    rng = random.Random(11)
    pick = lambda *v: rng.choice([None, *v])
    rows = [(pick(1, 2), pick("a", "b", "a b", "c"), pick("a", "b"), pick("a", "b")) for _ in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = _rows(exact_dedup.drop_copies(docs))
    plain = lambda t: (t or "").replace(" ", "")
    best = {}
    for r in rows:      # most characters, then the smallest id, rows without one last
        best.setdefault(plain(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    want = sorted((k, *min(v)) for k, v in best.items())
    assert sorted((plain(r[1]), -len(r[1] or ""), r[0] is None, r[0] or 0) for r in got) == want
    assert all(r in rows for r in got)


def test_rows_that_differ_in_maps_and_variants(spark):
    schema = T.StructType([*DOCS.fields, T.StructField("m", T.MapType(T.StringType(), T.IntegerType())), T.StructField("a", T.ArrayType(T.StringType()))])
    rows = [(1, "same", "en", "s", {"k": 1}, [None, "x"]), (1, "other", "en", "s", {"k": 2}, ["x", None]), (1, "other", "en", "s", {"k": 2}, ["x", None])]
    docs = spark.createDataFrame(rows, schema).withColumn("v", F.parse_json(F.lit('{"z": [1, null]}')))
    assert docs.select(exact_dedup.row_key(docs).alias("k")).distinct().count() == 2
    same = docs.withColumn("text", F.lit("same"))
    assert same.select(exact_dedup.row_key(same).alias("k")).distinct().count() == 2
    assert exact_dedup.drop_copies(docs).count() == 2


def _change(spark, rows, op):
    docs = spark.createDataFrame(rows, DOCS)
    return token_counts.changes(docs, op, {"words": token_counts.word_count})


def test_interleaved_writers(spark):
    """A second batch is committed between another one's reading and its commit: that one is done again."""
    root = scratch_path(spark, "rollup-race")
    one, two = token_counts.RollupStore(spark, root), token_counts.RollupStore(spark, root)
    assert one.commit("load", _change(spark, [(1, "a b c", "en", "s"), (2, "d e", "en", "s")], "insert"))
    prepare, turns = one._prepare, []

    def meanwhile(*args):
        attempt = prepare(*args)
        if not turns:
            turns.append(two.commit("gone", _change(spark, [(1, "", "en", "s")], "delete")))
        return attempt

    one._prepare = meanwhile
    assert one.commit("revised", _change(spark, [(1, "a b c d e f", "en", "s")], "revise")) and turns == [True]
    # both took row 1 back; read one after the other, the revision puts it in again
    assert _rows(one.totals().select("docs", "tokens")) == [(2, 8)]
    assert sorted(one.committed()) == ["gone", "load", "revised"]


def test_two_attempts_of_one_batch(spark):
    root = scratch_path(spark, "rollup-twice")
    one, two = token_counts.RollupStore(spark, root), token_counts.RollupStore(spark, root)
    load = _change(spark, [(1, "a b c", "en", "s")], "insert")
    prepare, turns = one._prepare, []

    def meanwhile(*args):
        attempt = prepare(*args)
        if not turns:
            turns.append(two.commit("load", load))
        return attempt

    one._prepare = meanwhile
    assert one.commit("load", load) is False and turns == [True]
    assert _rows(one.totals().select("docs", "tokens")) == [(1, 3)]
