"""Hard negatives by exact integer inner products.

Vectors are scaled to integers, ``floor(scale * x)`` per component in doubles.  A
row's score for an anchor is their integer inner product.  An anchor's positives
are its ``positives`` best other rows of the same label; for each of them the
first ``negatives`` rows of another label are returned whose score lies between
``low`` and ``high`` hundredths of the positive's.  Higher scores come first, ties
by smaller id.

Scores come from tiles of anchors times candidates in 64-bit integers.  A product
is split into halves in all three dimensions, an odd one filled up with a row or
column of zeros, and made of seven products of sums and differences (Strassen),
down to ``LEAF``.  Additions are exact, and as integers wrap, so would be an
intermediate sum beyond 64 bits, as the result itself fits.

Two scans of the candidates per block of anchors: the first keeps the best
positives of every anchor, the second, which knows them, the best rows of every
(anchor, positive) window.  Both kinds of lists are bounded per task and merge as
in ``best``.  Anchors go to the tasks in blocks of about ``ANCHOR_BYTES``, so the
broadcast is bounded and no candidate is ever shuffled; the work is anchors times
candidates, as every row is compared with every anchor.

Defined results: rows with a null id (they could not be named), label or vector, or
with a null or non-finite component, take no part, nor do rows whose scaled vector
is longer than 2^28, as the scores of others always fit 64 bits a hundredfold;
vectors of different length are not compared; rows that repeat an id are rows of
their own, in any order; an anchor without positives, or a window without rows,
gives none; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.best import merged, schema, task_rows
from hostlens.llm.common import batch_rows, parked

LEAF = 32
TILE = 512
#: Bytes of anchors (64-bit components) that one pair of scans compares, and so the bound of its broadcasts.
ANCHOR_BYTES = 16 << 20
LONGEST = float(1 << 28)
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` in 64-bit integers."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = (np.pad(x, [(0, s % 2) for s in x.shape]) if any(s % 2 for s in x.shape) else x for x in (a, b))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The ``k`` best (score, id, uid) of each slot so far, as flat arrays."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, LEAST)
        self.slot, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))

    def offer(self, slots: np.ndarray, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Candidates (columns) for ``slots`` (rows) where ``wanted``."""
        if not wanted.any():
            return
        floor = self.floor[slots]
        if scores.shape[1] > self.k:
            # nothing under a row's k-th best can be among its k best
            held = np.where(wanted, scores, LEAST)
            floor = np.maximum(floor, np.partition(held, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(wanted & (scores >= floor[:, None]))
        if not len(i):
            return
        slot, score, id_, uid = (np.concatenate(p) for p in ((self.slot, slots[i]), (self.score, scores[i, j]), (self.id, ids[j]), (self.uid, uids[j])))
        order = np.lexsort((uid, id_, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        order, kth = order[place < self.k], place == self.k - 1
        self.slot, self.score, self.id, self.uid = slot[place < self.k], score[order], id_[order], uid[order]
        at = slot[kth]
        self.floor[at] = self.score[np.flatnonzero(place[place < self.k] == self.k - 1)]

    def rows(self) -> pa.RecordBatch:
        # the complement falls as the id rises, so that a larger entry is a better one
        return task_rows(self.slot, {"score": self.score, "not_id": ~self.id, "not_uid": ~self.uid}, self.k)


class Anchors:
    """A block of anchors by vector length, and what their positives' windows are."""

    def __init__(self, rows: list):
        self.uids, self.ids = np.array([r.uid for r in rows], np.int64), np.array([r.vec_id for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims = np.array([len(r.v) for r in rows])
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            self.by_dim[int(d)] = (at, np.array([rows[i].v for i in at], np.int64).reshape(len(at), int(d)))

    def tiles(self, batches):
        """(anchors' places, their scores of the candidates, candidates' ids, uids, labels)."""
        for b in batches:
            uids, ids, labels, dims = (np.asarray(b.column(i)) for i in range(4))
            for d in np.unique(dims):
                if int(d) not in self.by_dim:
                    continue
                at = np.flatnonzero(dims == d)
                x = np.asarray(b.column(4).take(pa.array(at)).flatten()).astype(np.int64).reshape(len(at), int(d)).T
                places, matrix = self.by_dim[int(d)]
                for i in range(0, len(places), TILE):
                    yield places[i:i + TILE], strassen(matrix[i:i + TILE], x), ids[at], uids[at], labels[at]

    def positives(self, batches, k: int):
        heaps = Heaps(len(self.ids), k)
        for at, scores, ids, uids, labels in self.tiles(batches):
            heaps.offer(at, scores, (self.labels[at][:, None] == labels) & (self.uids[at][:, None] != uids), ids, uids)
        yield heaps.rows()

    def windows(self, batches, positive: np.ndarray, held: np.ndarray, low: int, high: int, k: int):
        """``positive``: scores of each anchor's positives (anchors x positives), where ``held``; a window's slot is its place there."""
        heaps, width = Heaps(positive.size, k), positive.shape[1]
        for at, scores, ids, uids, labels in self.tiles(batches):
            other = self.labels[at][:, None] != labels
            for p in range(width):
                s = positive[at, p][:, None]
                wanted = other & held[at, p][:, None] & (low * s <= 100 * scores) & (100 * scores <= high * s)
                heaps.offer(at * width + p, scores, wanted, ids, uids)
        yield heaps.rows()


def scaled(vector: Column, scale: int) -> Column:
    """The integer vector of a row that takes part, else null."""
    x = vector.cast("array<double>")
    y = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LONGEST))
    norm = F.aggregate(F.transform(x, lambda c: F.pow(F.floor(F.lit(float(scale)) * c).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, c: s + c)
    return F.when(whole & x.isNotNull(), F.when(norm <= LONGEST ** 2, y.cast("array<int>")))


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` and ``label``
    are expressions over ``vectors``."""
    spark = vectors.sparkSession
    batch_rows(spark, TILE)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                          scaled(F.col(vec_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = parked(rows.where("vec_id is not null and label is not null and v is not null")
                  .select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.size("v").alias("dim"), "v", "anchor"), "vectors")
    anchors = rows.where("anchor")
    size = anchors.agg(F.sum(F.lit(8) * (F.col("dim") + 8))).first()[0] or 0
    blocks = max(1, -(-size // anchor_bytes))
    out = None
    for block in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).select("uid", "vec_id", "label", "v").orderBy("uid").collect()
        mined = _mined(rows.select("uid", "vec_id", "label", "dim", "v"), part, positives, negatives, low, high)
        out = mined if out is None else out.unionByName(mined)
    return out


def _mined(rows: DataFrame, part: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The results of one block of anchors."""
    spark, fields = rows.sparkSession, ["score", "not_id", "not_uid"]
    sent = spark.sparkContext.broadcast(Anchors(part))
    found = parked(rows.mapInArrow(lambda batches: sent.value.positives(batches, positives), schema(fields)), "positives")
    best = parked(merged(found, positives).select("slot", "rank", "score", F.bitwise_not("not_id").alias("id")), "best-positives")
    score, held = np.zeros((len(part), positives), np.int64), np.zeros((len(part), positives), bool)
    got = best.select("slot", "rank", "score").toArrow()       # of a block's anchors
    at, rank = np.asarray(got.column("slot")), np.asarray(got.column("rank")) - 1
    score[at, rank], held[at, rank] = np.asarray(got.column("score")), True
    sent2 = spark.sparkContext.broadcast((score, held))
    found = parked(rows.mapInArrow(lambda batches: sent.value.windows(batches, *sent2.value, low, high, negatives), schema(fields)), "windows")
    names = spark.createDataFrame([(i, r.vec_id) for i, r in enumerate(part)], "anchor int, anchor_id long")
    pairs = best.select((F.col("slot") * positives + F.col("rank") - 1).alias("slot"), F.col("slot").alias("anchor"),
                        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    mined = merged(found, negatives).select("slot", "rank", F.bitwise_not("not_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (mined.join(pairs, "slot").join(F.broadcast(names), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
