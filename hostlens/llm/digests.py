"""Document fingerprints as improbable-feature digests.

A feature is a window of ``WINDOW`` bytes of a text (a shorter text is one
feature, filled up with zero bytes).  A window's entropy, scaled to 0..1000,
gives its rarity: the fewer windows of the whole corpus have that entropy, the
lower its rank; entropies under ``WEAK`` (runs of few different bytes) rank
after all others.  Every feature starts a stretch of ``STRETCH`` features (cut
at the text's end), and the leftmost feature of lowest rank in it gains a point.
Features with 16 points are selected; where fewer than ``ENOUGH`` have them,
those with 8, 4, 2 or 1.  Each distinct selected feature, in order of the text,
sets five of the 2048 bits of a Bloom filter; after ``PER_FILTER`` features the
chain goes on with a new filter.  A fingerprint is the chain's filters in
base64, joined by points; a text without bytes has none and an empty fingerprint.

Likeness of two fingerprints: for each filter of the shorter chain the best
normalised overlap with a filter of the other, averaged by their set bits (of
chains of equal length, the mean of both directions).  The normalised overlap of
filters with s and t set bits and e common ones is ``(e - c) / (min(s, t) - c)``,
0 at least, where c is what chance explains: the mean ``s t / 2048`` and three
standard deviations.  Equal fingerprints are alike by 1, an empty and another by 0.

Entropies need no counting per window: when the window moves on by one byte, the
sum of c log2 c changes by what the left byte's count among the bytes after it and
the right byte's count among the bytes before it say, and both come from comparing
the text with itself shifted by 1 to ``WINDOW - 1``.  Texts are worked on in
pieces of ``PIECE`` positions, so memory does not grow with a long text but for
the text itself.

``with_next`` puts texts next to each other in the order of falling ids: the
keys alone are range-partitioned to find bounds, then each text moves once, to
its range, and the first one of a range also to the range before it.

Defined results: a null text counts as empty; rows without an id come last in the
order, rows with equal ids in the order of their text's hash, and rows equal in both
in any order (they stay in one range, read as a stream); the last row's next one is the first, a
lone row's next one is itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import TEXT_ROWS, batch_rows, parked

WINDOW, STRETCH = 32, 64
BINS, WEAK = 1001, 250
POINTS, ENOUGH = (16, 8, 4, 2, 1), 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
PIECE = 1 << 19
#: New text that is fingerprinted at a time.
PORTION = 1 << 20
#: Bytes of text per range of ``with_next``, and the most ranges there are (their bounds are broadcast).
RANGE_BYTES, RANGES = 16 << 20, 1 << 16

_COUNT = np.arange(WINDOW + 1)
#: c log2 c in units of 1/1024, and what one more equal byte adds.
_SUM = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * 1024).astype(np.int32)
_GAIN = np.diff(_SUM)
_MOST = int(_SUM[-1])


def entropy_bins(x: np.ndarray) -> np.ndarray:
    """Scaled entropy of every window of the bytes ``x`` (at least one window)."""
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    s = np.empty(n - WINDOW + 1, np.int32)
    s[0] = _SUM[np.bincount(x[:WINDOW], minlength=256)].sum()
    np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[:n - WINDOW]], dtype=np.int32, out=s[1:])
    s[1:] += s[0]
    return (BINS - 1) - (s * np.int32(BINS - 1) + np.int32(_MOST // 2)) // np.int32(_MOST)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts with gaps, start of each text, number of its features)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + STRETCH)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    gap = bytes(STRETCH)
    return np.frombuffer(gap.join([*texts, b""]), np.uint8), starts, np.where(sizes > 0, np.maximum(1, sizes - WINDOW + 1), 0)


def _valid(n: int, starts: np.ndarray, features: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, f in zip(starts.tolist(), features.tolist()):
        out[a:a + f] = True
    return out


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    x, starts, features = laid_out(texts)
    valid, out = _valid(len(x), starts, features), np.zeros(BINS, np.int64)
    for lo in range(0, max(0, len(x) - WINDOW + 1), PIECE):
        bins = entropy_bins(x[lo:lo + PIECE + WINDOW - 1])
        out += np.bincount(bins[valid[lo:lo + len(bins)]], minlength=BINS)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest first, weak ones after all others."""
    order = np.lexsort((np.arange(BINS), counts, np.arange(BINS) < WEAK))
    out = np.empty(BINS, np.int32)
    out[order] = np.arange(BINS)
    return out


def points(x: np.ndarray, valid: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions with points, their points)."""
    at, got = [], []
    last = len(x) - WINDOW + 1       # number of windows
    for lo in range(0, max(0, last), PIECE):
        hi = min(lo + PIECE, last)
        a, b = max(0, lo - STRETCH + 1), min(hi + STRETCH - 1, last)
        key = rank[entropy_bins(x[a:b + WINDOW - 1])] * np.int32(1 << 20) + np.arange(b - a, dtype=np.int32)
        ok = valid[a:b]
        key = np.where(ok, key, np.int32(2**31 - 1))
        low = np.concatenate([key, np.full(STRETCH - 1, 2**31 - 1, np.int32)])
        step = 1
        while step < STRETCH:        # minima over 2, 4, ... features
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        # stretches that start up to the piece's end; points of positions inside the piece
        best = (low[:hi - a][ok[:hi - a]] & np.int32((1 << 20) - 1)) + a
        n = np.bincount(best[(best >= lo) & (best < hi)] - lo, minlength=1)
        p = np.flatnonzero(n)
        at.append(p + lo)
        got.append(n[p])
    return (np.concatenate(at), np.concatenate(got)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def feature_hashes(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows that start at ``at``."""
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 16):
        words = x[at[i:i + (1 << 16), None] + np.arange(WINDOW)].view("<u8")
        h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        out[i:i + (1 << 16)] = h ^ (h >> np.uint64(32))
    return out


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The Bloom filters (filters x 256 bytes) of each text."""
    x, starts, features = laid_out(texts)
    at, got = points(x, _valid(len(x), starts, features), rank)
    doc = np.searchsorted(starts, at, side="right") - 1
    least = np.ones(len(texts), np.int64)
    for p in reversed(POINTS):
        least[np.bincount(doc[got >= p], minlength=len(texts)) >= ENOUGH] = p
    chosen = got >= least[doc]
    at, doc = at[chosen], doc[chosen]
    h = feature_hashes(x, at)
    # the first of equal features of a text, in order of the text
    order = np.lexsort((at, h, doc))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    keep = np.sort(order[first])
    h, doc = h[keep], doc[keep]
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    filters = -(-n // PER_FILTER)
    begin = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    row = begin[doc] + place // PER_FILTER
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[b:b + f] for b, f in zip(begin.tolist(), filters.tolist())]


def as_text(chain: np.ndarray) -> str:
    return ".".join(base64.b64encode(f.tobytes()).decode() for f in chain)


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(b"".join(base64.b64decode(f) for f in fingerprint.split(".") if f), np.uint8).reshape(-1, BITS // 8)


def _one_way(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of ``a`` of the best normalised overlap with one of ``b``, by set bits."""
    other = np.unpackbits(b, axis=1).astype(np.float32)
    t = other.sum(axis=1).astype(np.float64)
    total = weight = 0.0
    for i in range(0, len(a), 256):
        one = np.unpackbits(a[i:i + 256], axis=1).astype(np.float32)
        s = one.sum(axis=1).astype(np.float64)[:, None]
        common, mean = (one @ other.T).astype(np.float64), s * t / BITS
        chance = mean + 3 * np.sqrt(mean * (1 - s / BITS) * (1 - t / BITS))
        most = np.minimum(s, t)
        best = np.where(most > chance, (common - chance) / np.where(most > chance, most - chance, 1), 0).clip(0, 1).max(axis=1)
        total += float(best @ s[:, 0])
        weight += float(s.sum())
    return total / weight


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two chains, 0 to 1."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) == len(b):
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if len(a) < len(b) else _one_way(b, a)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of the start of ``following``, or all of it."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropies by the windows of all texts."""
    batch_rows(docs.sparkSession, TEXT_ROWS)

    def count(batches):
        total, texts, size = np.zeros(BINS, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= PORTION:
                    total += entropy_counts(texts)
                    texts, size = [], 0
        total += entropy_counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    for r in docs.select(text).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    return ranks(counts)


def with_next(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(range, role, no_id, place, tie, doc_id, text): each range is one sorted partition in the order of
    falling ids; after its own rows (role 0) comes the row that follows them (role 1)."""
    spark = docs.sparkSession
    batch_rows(spark, TEXT_ROWS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    # the complement of the id falls as the id rises
    place = [doc_id.isNull().cast("int").alias("no_id"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("place"),
             F.xxhash64(text).alias("tie")]
    keys = parked(docs.select(*place, F.octet_length(text).alias("size")), "order")
    size = keys.agg(F.sum("size"), F.count("*")).first()
    rows = docs.select(*place, doc_id.alias("doc_id"), text.cast("binary").alias("text"))
    n = max(1, min(RANGES, max(spark.sparkContext.defaultParallelism, -(-(size[0] or 0) // range_bytes))))
    heads = (keys.repartitionByRange(n, "no_id", "place", "tie").select(F.spark_partition_id().alias("part"), F.struct("no_id", "place", "tie").alias("key"))
             .groupBy("part").agg(F.min("key").alias("key")).select("key.*").distinct())
    bounds = spark.sparkContext.broadcast(sorted(tuple(r) for r in heads.collect()))     # one per range
    last = len(bounds.value) - 1

    def route(batches):
        heads = bounds.value
        for b in batches:
            if not b.num_rows:
                continue
            key = list(zip(*[b.column(i).to_pylist() for i in range(3)]))
            own = np.array([bisect.bisect_right(heads, k) - 1 for k in key], np.int32)
            head = np.flatnonzero([heads[o] == k for o, k in zip(own.tolist(), key)])
            before = np.where(own[head] > 0, own[head] - 1, last).astype(np.int32)
            for at, where, role in ((np.arange(b.num_rows), own, 0), (head, before, 1)):
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.full(len(at), role, np.int32)), *part.columns],
                                                 names=["range", "role", "no_id", "place", "tie", "doc_id", "text"])

    routed = rows.mapInArrow(route, "range int, role int, no_id int, place long, tie long, doc_id long, text binary")
    return routed.repartitionById(last + 1, "range").sortWithinPartitions("range", "role", "no_id", "place", "tie") if last >= 0 else routed


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes]]:
    for b in batches:
        yield from zip(b.column(1).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist())


FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row its text's fingerprint, that of its edited text, and its likeness to both that and the next
    text's; ``rank`` is what ``rarity`` gives, by default of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(rarity(docs, text_col) if rank is None else rank)

    def compare(batches):
        rank, rows = sent.value, _streamed(batches)
        held = None      # the last row, whose next one is not there yet, with its text and chain
        while True:
            new, size = [], 0
            for row in rows:
                new.append(row)
                size += len(row[2])
                if size >= PORTION or len(new) >= TEXT_ROWS:
                    break
            if not new:
                return
            texts = [t.decode("utf-8", "surrogateescape") for _, _, t in new]
            line = ([held[0]] if held else []) + new
            chars = ([held[1]] if held else []) + texts
            # rows that follow a range's last one are only looked at
            own = [i for i in range(len(line) - 1) if line[i][0] == 0]
            other = [edited(chars[i], chars[i + 1]).encode("utf-8", "surrogateescape") for i in own]
            made = chains([t for _, _, t in new] + other, rank)
            mine = ([held[2]] if held else []) + made[:len(new)]
            changed = made[len(new):]
            if own:
                yield pa.RecordBatch.from_arrays([
                    pa.array([line[i][1] for i in own], pa.int64()), pa.array([len(chars[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in other]), pa.array([as_text(mine[i]) for i in own]),
                    pa.array([as_text(c) for c in changed]), pa.array([likeness(mine[i], c) for i, c in zip(own, changed)], pa.float64()),
                    pa.array([likeness(mine[i], mine[i + 1]) for i in own], pa.float64())], names=[f.split()[0] for f in FINGERPRINTS.split(", ")])
            held = (line[-1], chars[-1], mine[-1])

    return with_next(docs, id_col, text_col, range_bytes).mapInArrow(compare, FINGERPRINTS)
