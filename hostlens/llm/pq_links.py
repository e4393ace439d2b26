"""Embedding near-duplicates with an inverted product-quantisation index.

Vectors link when their labels are equal and their cosine is at least
``threshold``.  Equal vectors of a label are one class with a weight, so copies
are never expanded into pairs.  The index: a coarse k-means quantiser gives
inverted lists; a vector's residual is cut into subspaces, each replaced by its
nearest codeword.  A query looks into every list that can hold a partner,
computes asymmetric distances by table look-up over the codes of the list, and
only survivors are compared exactly in double precision.

Both filters are lossless.  On the unit sphere a cosine of t means a distance
of r = sqrt(2 - 2 t).  A partner x of q lies within r of q, and on its own side
of the plane between the centroids c (of x) and d (of q); so list c is probed
if |q - c|^2 - |q - d|^2 <= 2 r |c - d|.  The code of x is at a known distance
e from x, so x is skipped only if its table distance exceeds r + e.  Recall is
therefore 1 for any fit; the fit only decides the cost.

The quantisers are fitted on the driver on at most ``fit_rows`` classes (a
sample by hash); every row is indexed.  Lists longer than ``chunk`` are met by
their queries in chunk x chunk blocks, each block a group of bounded size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or a null vec_id, link with nothing
(n_links 0, component_id = vec_id, kept); vectors of different length do not
link; rows repeating a vec_id count as separate vectors; empty tables give
empty results.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import components, grouped_batches, group_starts, map_batches, parked, star_edges

SLACK = 1e-4     # rounding of 32-bit tables and codes


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)       # so that squares neither overflow nor vanish
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, seed: int, turns: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(turns):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norms = (c * c).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *[(norms - 2 * x[i:i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)]])


def fit(sample: dict[int, np.ndarray], lists: int, parts: int = 8, words: int = 256, seed: int = 7) -> dict:
    """Per vector length: centroids, subspace bounds and codebooks."""
    model = {}
    for dim, x in sample.items():
        k = max(1, min(lists, len(x) // 16))
        centroids = _kmeans(x, k, seed)
        residual = x - centroids[_nearest(x, centroids)]
        cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int).tolist()
        books = [_kmeans(residual[:, a:b], min(words, len(x)), seed + a) for a, b in pairwise(cuts)]
        model[dim] = (centroids, cuts, books)
    return model


def index_rows(x: np.ndarray, model: tuple | None, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(list, codes, code error, lists to probe) of unit vectors."""
    if model is None:       # a vector length that the sample did not hold: one list, compared exactly
        n = len(x)
        return np.zeros(n, np.int64), np.zeros((n, 1), np.uint8), np.full(n, np.inf), [[0]] * n
    centroids, cuts, books = model
    d2 = ((x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)) - 2 * x @ centroids.T
    own = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, ((centroids[own][:, None] - centroids[None]) ** 2).sum(axis=2))) if len(centroids) <= 64 else \
        np.sqrt(np.maximum(0, (centroids[own] ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1) - 2 * centroids[own] @ centroids.T))
    reach = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * (radius + SLACK) * apart + SLACK
    reach[np.arange(len(x)), own] = True
    residual = x - centroids[own]
    codes = np.stack([_nearest(residual[:, a:b], book) for (a, b), book in zip(pairwise(cuts), books)], axis=1).astype(np.uint8)
    coded = np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], axis=1)
    error = np.linalg.norm(residual - coded, axis=1)
    return own, codes, error, [np.flatnonzero(r).tolist() for r in reach]


def block_links(q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, centroid: np.ndarray | None, cuts: list,
                books: list, threshold: float) -> np.ndarray:
    """Which of the unit vectors ``x`` (rows of one list) each of ``q`` links with."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    if centroid is None:
        near = np.ones((len(q), len(x)), bool)
    else:
        residual = q - centroid
        d2 = np.zeros((len(q), len(x)), np.float32)
        for m, ((a, b), book) in enumerate(zip(pairwise(cuts), books)):
            part = residual[:, a:b]
            look_up = ((part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * part @ book.T).astype(np.float32)
            d2 += look_up[:, codes[:, m]]
        near = d2 <= ((radius + error) ** 2 + SLACK)[None]
    if near.mean() > 0.02:
        return near & (q @ x.T >= threshold)
    i, j = np.nonzero(near)
    linked = np.zeros_like(near)
    linked[i, j] = np.einsum("ij,ij->i", q[i], x[j]) >= threshold
    return linked


def _usable() -> Column:
    """Whether a row (vec_id, label, vec) can link at all; never null."""
    v = F.col("vec")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & good, F.lit(False))


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   threshold: float = 0.98, fit_rows: int = 32768, list_rows: int = 1024, chunk: int = 2048) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"),
                          F.col(label_col).cast("string").alias("label"))
    # vectors travel as they came, in 32 bits where that is what they are, and are scaled to length 1 where they meet
    dtype = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    key = F.sha2(F.to_json(F.struct("vec")), 256)
    usable = rows.where(_usable())
    classes = parked(usable.groupBy("label", key.alias("key")).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes").withColumn("dim", F.size("vec"))
    totals = classes.groupBy("label").count().agg(F.sum("count").alias("n"), F.count("*").alias("labels")).first()
    n, labels = totals.n or 0, max(1, totals.labels)
    share = min(1.0, fit_rows / max(1, n))
    # a sample by hash of the key; the limit only guards the documented bound
    taken = (classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
             .select("dim", "vec").limit(fit_rows).toArrow())
    dims, by_dim = np.asarray(taken.column("dim")), {}
    flat = taken.column("vec").combine_chunks()
    for d in np.unique(dims):
        by_dim[int(d)] = _unit(np.asarray(flat.filter(pa.array(dims == d)).flatten()), int(d))
    model = spark.sparkContext.broadcast(fit(by_dim, math.ceil(n / labels / list_rows)))

    def assign(b: pa.RecordBatch) -> list:
        dim, vec = np.asarray(b.column(3)), b.column(4)
        size = b.num_rows
        own, error = np.zeros(size, np.int64), np.zeros(size)
        codes, unit, probes = [None] * size, [None] * size, [None] * size
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            raw = np.asarray(vec.take(pa.array(at)).flatten())
            x, raw = _unit(raw, int(d)), raw.reshape(-1, int(d)).astype(dtype)
            own[at], c, error[at], p = index_rows(x, model.value.get(int(d)), radius)
            for k, i in enumerate(at.tolist()):
                codes[i], unit[i], probes[i] = c[k].tobytes(), raw[k].tobytes(), p[k]
        return [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(own), pa.array(error), pa.array(codes, pa.binary()),
                pa.array(unit, pa.binary()), pa.array(probes, pa.list_(pa.int64()))]

    entry = "label string, rep long, weight long, dim int, list long, error double, codes binary, unit binary, probes array<long>"
    entries = parked(map_batches(classes.select("label", "rep", "weight", "dim", "vec"), entry, assign, rows=2000), "index")
    # how many chunks of members and of queries each list has
    keys = ["label", "dim", "list"]
    probes = entries.select("label", "dim", F.explode("probes").alias("list"), "rep", "unit")
    held = entries.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_m"))
    asked = probes.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_q"))
    grid = parked(held.join(asked, keys), "lists")
    members = (entries.join(grid, keys).withColumn("cm", F.pmod(F.hash("rep"), F.col("n_m")))
               .withColumn("cq", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
               .select(*keys, "cm", "cq", F.lit(0).alias("kind"), "rep", "weight", "error", "codes", "unit"))
    queries = (probes.join(grid, keys).withColumn("cq", F.pmod(F.hash("rep"), F.col("n_q")))
               .withColumn("cm", F.explode(F.sequence(F.lit(0), F.col("n_m") - 1)))
               .select(*keys, "cm", "cq", F.lit(1).alias("kind"), "rep", F.lit(0).cast("long").alias("weight"), F.lit(0.0).alias("error"),
                       F.lit(None).cast("binary").alias("codes"), "unit"))
    # a group's number in place of its label and list, so that keys are plain integers
    group = F.xxhash64(*keys, "cm", "cq").alias("g")
    met = members.unionByName(queries).select(group, *keys, "cm", "cq", "kind", "rep", "weight", "error", "codes", "unit")

    def compare(batches):
        for t in grouped_batches(batches, 1, 20_000):
            starts = group_starts([t.column(0)])
            for a, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                yield from _compare_group(t.slice(a, e - a), model.value, threshold, dtype)

    found = parked(met.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    per_class = parked(classes.select("label", "key", "first_id", "rep", "weight").join(counts, "rep", "left").join(roots, "rep", "left")
                       .select("label", "key", "first_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
                               F.coalesce("root", "rep").alias("root")), "class-links")
    names = per_class.groupBy("root").agg(F.min("first_id").alias("component"))
    named = per_class.join(names, "root").select("label", "key", "n", "component")
    linked = usable.select("vec_id", "label", key.alias("key")).join(named, ["label", "key"]).select("vec_id", "n", "component")
    rest = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    return linked.unionByName(rest).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"),
                                           F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def _compare_group(t: pa.Table, model: dict, threshold: float, dtype: str, rows: int = 256):
    """Links of one (list, chunk, chunk) group; groups of one hash that differ in key are kept apart."""
    keys = list(zip(*[t.column(i).to_pylist() for i in range(1, 6)]))
    kind, rep, weight = (np.asarray(t.column(i)) for i in (6, 7, 8))
    code = np.unique([str(k) for k in set(keys)])
    group = np.zeros(len(keys), int) if len(code) == 1 else np.searchsorted(code, [str(k) for k in keys])
    for g in range(len(code)):
        m, q = np.flatnonzero((kind == 0) & (group == g)), np.flatnonzero((kind == 1) & (group == g))
        if not len(m) or not len(q):
            continue
        _, dim, lst = keys[m[0]][:3]
        unit, codes_col = t.column(11), t.column(10)
        x = _unit(np.frombuffer(b"".join(unit.take(pa.array(m)).to_pylist()), dtype), dim)
        codes = np.frombuffer(b"".join(codes_col.take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
        error = np.asarray(t.column(9))[m]
        centroids, cuts, books = model.get(dim, (None, [], []))
        centroid = None if centroids is None else centroids[lst]
        for i in range(0, len(q), rows):
            part = q[i:i + rows]
            y = _unit(np.frombuffer(b"".join(unit.take(pa.array(part)).to_pylist()), dtype), dim)
            linked = block_links(y, x, codes, error, centroid, cuts, books, threshold) & (rep[part][:, None] != rep[m][None])
            n = linked @ weight[m]
            hit = n > 0
            if hit.any():
                u, v = star_edges(linked, rep[part], rep[m])
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none], names=["u", "v", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(rep[part][hit]), pa.nulls(int(hit.sum()), pa.int64()), pa.array(n[hit].astype(np.int64))], names=["u", "v", "n"])
