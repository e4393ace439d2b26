"""Ranked search by max-sketches and hard negatives by tiles, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm import hard_negatives, max_sketch
from tests.conftest import SMALL
from tests.llm.helpers import DOCS, no_docs, odd_docs, with_clashes
from tests.llm.test_vectors import VECTORS

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def _ranked(docs, items, k):
    """Ranks of (doc_id, score) per item; documents without an id come last of equal scores."""
    bags = [(i, Counter(_words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in bags:
            if c:
                m = 50 + 50 * c.total() * n_docs // n_terms
                scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                                    for t in set(_words(text)) if t in c), i is None, i or 0))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item, r + 1, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(best)]
    return sorted(out, key=repr)


def _got(df):
    assert df.columns[:4] == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width,block", [(4096, 4 << 20), (8, 4 << 20), (64, 300)])
def test_ranked_search(spark, width, block):
    """Any sketch width and any cut of the queries into blocks give the exact ranks."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12)
    rows, asked = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    got = _got(max_sketch.search(docs.repartition(5), spark.createDataFrame(asked, ITEMS), k=7, width=width, block_bytes=block))
    assert got == _ranked(rows, asked, 7)


def test_search_of_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names; queries without an id or a term."""
    docs = odd_docs(spark)
    asked = [(1, "SAME words, here!"), (2, None), (3, ""), (None, "alpha lorem"), (1, "SAME words, here!"), (4, "ünïcödé 日本語 A"), (5, "unknownterm"), (6, "lorem " * 5000)]
    want = _ranked([(r.doc_id, r.text) for r in docs.collect()], asked, 4)
    assert sum(r[2] is None for r in want) > 0
    items = with_clashes(spark.createDataFrame(asked, ITEMS)).withColumn("q", F.lit("x")).withColumn("doc_id", F.lit(1))
    for n in (1, 9):
        assert _got(max_sketch.search(docs.withColumn("item_id", F.lit(3)).repartition(n), items, k=4)) == want
    assert max_sketch.search(no_docs(spark), items).count() == 0
    assert max_sketch.search(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_many_equal_documents(spark):
    """A group of copies larger than k in every task: the smallest ids rank first."""
    docs = spark.createDataFrame([(i, "one two three" if i % 2 else "two four", "en", "a") for i in range(3000, 0, -1)], DOCS)
    got = _got(max_sketch.search(docs.repartition(13), spark.createDataFrame([(0, "three one")], ITEMS), k=4))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 3), (0, 3, 5), (0, 4, 7)]


def test_bounds_never_fall_short():
    rng = random.Random(3)
    for _ in range(30):
        bags = [Counter(b"w%d" % rng.randrange(60) for _ in range(rng.randrange(1, 90))) for _ in range(20)]
        query = b" ".join(b"w%d" % rng.randrange(70) for _ in range(8))
        df, n_terms = Counter(t for c in bags for t in c), sum(c.total() for c in bags)
        q = max_sketch.Queries([query], df, len(bags), n_terms, 3, 16)
        m = [max_sketch.length_factor(c.total(), len(bags), n_terms) for c in bags]
        (cols, w), = q.lookups()
        bounds = w @ max_sketch.fold(bags, m, 16, q.column, q.columns)[cols] if len(cols) else np.zeros(len(bags))
        exact = [sum(w * max_sketch.impact(c[t], f) for t, w in q.weights[0].items() if t in c) for c, f in zip(bags, m)]
        assert (bounds >= exact).all()


def test_strassen_is_exact():
    rng = np.random.default_rng(2)
    for m, k, n in ((1, 1, 1), (70, 65, 33), (129, 64, 200), (67, 0, 40), (40, 131, 97)):
        a, b = rng.integers(-(1 << 27), 1 << 27, (m, k)), rng.integers(-(1 << 27), 1 << 27, (k, n))
        for leaf in (1, 8, 32):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    big = np.full((64, 64), 1 << 28)     # sums that wrap on the way
    assert (hard_negatives.strassen(big, big, 4) == big @ big).all()


def _mined(rows, every, positives, negatives):
    good = []
    for i, (v, e, lab) in enumerate(rows):
        if v is not None and lab is not None and e is not None and all(c is not None and math.isfinite(c) for c in e):
            x = [math.floor(256 * float(np.float32(c))) for c in e]
            if sum(c * c for c in x) <= 1 << 56:
                good.append((i, v, x, lab))
    out = []
    for i, v, x, lab in good:
        if v % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), w, j, other) for j, w, y, other in good if j != i and len(x) == len(y))
        for s, p, _, _ in [r for r in scores if r[3] == lab][:positives]:
            held = [(n, -t) for t, n, _, other in scores if other != lab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(v, p, r + 1, n, -s, t) for r, (n, t) in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 2000])
def test_hard_negatives(spark, block):
    """Against all scores by hand: ties by id, repeated ids and vectors, several blocks of anchors."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-4, 9, 33).astype(np.float32) / 8], int(i % 3)) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)] + [(10, rows[3][1], 0), (10, rows[4][1], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(6), F.col("vec_id") % 10 == 0, anchor_bytes=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _mined(rows, 10, 5, 3)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want


def test_hard_negatives_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2), (3, [0.6, 0.1], 3), (None, [1.0, 0.0], 2), (4, None, 2),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [0.9, 0.1], None), (20, [], 1), (21, [], 1), (22, [], 2), (30, [1.0, 0.0, 0.0], 1),
            (31, [3e38, 0.0], 2), (32, [0.0, 0.0], 1), (40, [-1.0, -0.5], 1), (-10, [0.75, 0.5], 1)]
    got = hard_negatives.mine(with_clashes(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, 10, 5, 3)
    for few in ([], [(1, [1.0], 1)], [(10, None, 1)], [(10, [1.0], 1)]):
        assert hard_negatives.mine(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 10 == 0).count() == 0
