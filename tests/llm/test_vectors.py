"""The product-quantisation index against brute force: links, components, recall."""

import numpy as np
from pyspark.sql import types as T

from hostlens.llm import pq_links
from tests.llm.helpers import union_find, with_clashes

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def _brute(rows, threshold):
    good = []
    for i, (v, e, lab) in enumerate(rows):
        x = None if e is None or any(c is None for c in e) else np.array(e, np.float32).astype(float)
        if v is not None and lab is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            good.append((i, x / np.linalg.norm(x), lab))
    pairs = [(a, b) for k, (a, x, la) in enumerate(good) for b, y, lb in good[k + 1:] if la == lb and len(x) == len(y) and x @ y >= threshold]
    n = np.zeros(len(rows), int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    find = union_find(pairs)
    name = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            name[find(i)] = min(name.get(find(i), v), v)
    return [(v, int(n[i]), name.get(find(i)) if v is not None else None) for i, (v, _, _) in enumerate(rows)], pairs


def _vectors(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    rows = []
    for i in range(n):
        x = base[i % len(base)] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.1, 0.3, 1.0])
        rows.append((i, [float(c) for c in x.astype(np.float32)], int(i % len(base) % 3)))
    return rows


def test_links_and_components(spark):
    rows = _vectors()
    hot = _vectors()[0][1]
    rows += [(2000 + i, hot, 0) for i in range(40)]      # one group of equal vectors
    want, pairs = _brute(rows, 0.98)
    assert len(pairs) > 300
    df = spark.createDataFrame(rows, VECTORS)
    for lists, chunk in ((1024, 2048), (20, 2048), (20, 16)):      # one list, many lists, cut lists
        got = pq_links.linked_vectors(df, list_rows=lists, chunk=chunk).collect()
        # every link is found: recall 1 against brute force
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, [None, 1.0], 1), (9, [], 1), (None, [1.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2),
            (13, [1e-38, 0.0], 1), (14, [3e38, 0.0], 1), (14, [0.0, 1.0], 1), (14, [0.0, 1.0], 1), (15, [-1.0, 0.0], 1)]
    want, _ = _brute(rows, 0.98)
    got = pq_links.linked_vectors(with_clashes(spark.createDataFrame(rows, VECTORS))).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == sorted(want, key=repr)


def test_no_vectors(spark):
    assert pq_links.linked_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert pq_links.linked_vectors(spark.createDataFrame([(1, None, None)], VECTORS)).collect()[0].n_links == 0


def test_code_distances_never_lose_a_partner():
    """The table distances only prune vectors that are out of reach."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    x[250:] = x[:250] + 0.15 * rng.normal(size=(250, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = pq_links.fit({16: x[::3]}, 8, parts=4, words=16)
    own, codes, error, probes = pq_links.index_rows(x, model[16], 0.2)
    centroids, cuts, books = model[16]
    want = x @ x.T >= 0.98
    assert all(int(own[j]) in probes[i] for i, j in zip(*np.nonzero(want)))
    for c in range(len(centroids)):
        at = np.flatnonzero(own == c)
        got = pq_links.block_links(x, x[at], codes[at], error[at], centroids[c], cuts, books, 0.98)
        assert (got == want[:, at]).all()
