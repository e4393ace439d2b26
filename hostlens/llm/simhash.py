"""Near-duplicates by SimHash fingerprints, compared bit-sliced.

A text's words are the runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; its
shingles are ``shingle`` consecutive words joined by one space, repeats
included (fewer words: the whole sequence; none: fingerprint zero, linked like
any other).  A fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 (UTF-8, seed 42).  Fingerprints link at ``radius`` or fewer differing
bits; documents of one component are near-duplicates.

Candidates come from the pigeonhole principle: the 64 bits are cut into
``blocks`` > radius parts, so two linked fingerprints agree on at least
``blocks - radius`` whole parts.  Every choice of that many parts is a table,
and fingerprints meet in the buckets of a table.  ``blocks`` grows with the
number of fingerprints to keep buckets short; any value finds every link.
In a bucket, bit planes are stored vertically (one 64-bit word holds one bit of
64 fingerprints), distances are kept in carry-save bitwise counters, and a word
is abandoned once all of its 64 distances exceed the radius.  Buckets over
``chunk`` fingerprints are cut into chunks that meet pairwise in separate
groups.  A bucket emits a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; equal fingerprints are one node, so
repeated rows and copies cost nothing; a null doc_id never names a component
(unless all ids in it are null); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import NARROW_ROWS, batch_rows, components, grouped_batches, group_starts, keyed_rows, map_batches, one_of_each, parked, star_edges

SEED = 42
#: Hashes whose bits are added up at a time.
ADD_ROWS = 1 << 15
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int) -> int:
    from xxhash import xxh64_intdigest as xxh64
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    hashes = np.fromiter((xxh64(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, ADD_ROWS):
        part = hashes[i:i + ADD_ROWS]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, key: str | None = None) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row; ``key`` keeps that column too."""
    def run(b: pa.RecordBatch) -> list:
        fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        return [b.column(0), pa.array(fp), *b.columns[2:]]

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    more = [F.col(key).alias("key")] if key else []
    return map_batches(docs.select(*cols, *more), "doc_id long, fp long" + (", key string" if key else ""), run)


def tables(n: int, radius: int, target: int = 1024) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(parts as (shift, width), choices of parts): as few tables as keep the mean bucket at ``target`` of ``n``."""
    for blocks in range(radius + 1, min(64, radius + 5) + 1):
        cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        parts = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        agree = blocks - radius
        if n / 2 ** (64 * agree / blocks) <= target:
            break
    return parts, list(combinations(range(blocks), agree))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64 x words) of fingerprints: bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


def within(queries: np.ndarray, words: np.ndarray, where: np.ndarray, radius: int) -> np.ndarray:
    """Masks of the 64 fingerprints of ``words[:, where[i]]`` within ``radius`` bits of ``queries[i]``.

    Distances are carry-save counters: ``counter[k]`` holds bit k of 64
    distances at once, the last one is sticky (over the radius).
    """
    levels = (radius + 1).bit_length()
    start = (1 << levels) - 1 - radius     # so that the counters overflow when a distance exceeds the radius
    live = np.arange(len(queries))
    counter = [np.full(len(queries), ONES if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros(len(queries), np.uint64)
    out = np.zeros(len(queries), np.uint64)
    q, at = queries, where
    for b in range(64):
        carry = words[b][at] ^ (np.uint64(0) - (q >> np.uint64(b) & np.uint64(1)))
        for k in range(levels):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 7 and len(live):
            some = over != ONES
            if not some.all():
                live, q, at, over = live[some], q[some], at[some], over[some]
                counter = [c[some] for c in counter]
    out[live] = ~over
    return out


def _forest(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what ``a`` x ``b`` links join, by blocks of queries."""
    words, found = planes(b), []
    for i in range(0, len(a), rows):
        q = a[i:i + rows]
        w = words.shape[1]
        masks = within(np.repeat(q, w), words, np.tile(np.arange(w), len(q)), radius)
        linked = np.unpackbits(masks.astype("<u8").view(np.uint8), bitorder="little").reshape(len(q), -1)[:, :len(b)].astype(bool)
        if linked.any():
            found.append(star_edges(linked, q.view(np.int64), b.view(np.int64)))
    return found


def bucket_links(fps: np.ndarray, starts: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many buckets: fingerprints sorted by bucket, the buckets' first rows,
    and each row's side (0 or 1: chunks that meet; 2: meets its own)."""
    ends = np.append(starts[1:], len(fps))
    sizes = ends - starts
    us, vs = [], []
    small = np.flatnonzero((sizes > 1) & (sizes <= 64) & (side[starts] == 2))
    if len(small):
        # all small buckets at once: one word of planes each
        n = sizes[small]
        slot = np.repeat(np.arange(len(small)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        member = np.repeat(starts[small], n) + place
        words = np.zeros((64, len(small)), np.uint64)
        bit = np.uint64(1) << place.astype(np.uint64)
        first = np.cumsum(n) - n
        for b in range(64):
            words[b] = np.bitwise_or.reduceat((fps[member] >> np.uint64(b) & np.uint64(1)) * bit, first)
        masks = within(fps[member], words, slot, radius)
        masks &= ~bit
        masks &= bit - np.uint64(1)     # each pair once: earlier members only
        hit = np.flatnonzero(masks)
        if len(hit):
            bits = np.unpackbits(masks[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(bits)
            slots = slot[hit][i]
            us.append(fps[member[hit[i]]].view(np.int64))
            vs.append(fps[starts[small][slots] + j].view(np.int64))
    for g in np.flatnonzero((sizes > 1) & ((sizes > 64) | (side[starts] != 2))):
        f, s = fps[starts[g]:ends[g]], side[starts[g]:ends[g]]
        pairs = _forest(f, f, radius) if s[0] == 2 else _forest(f[s == 0], f[s == 1], radius)
        us += [x for x, _ in pairs]
        vs += [x for _, x in pairs]
    none = np.zeros(0, np.int64)
    u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
    keep = u != v
    return u[keep], v[keep]


def links(distinct: DataFrame, n: int, radius: int, chunk: int = 4096) -> DataFrame:
    """(u, v): links that join the same fingerprints as all links of ``distinct`` (column fp)."""
    parts, choices = tables(n, radius)

    def key(choice: tuple[int, ...]):
        k = F.lit(0).cast("long")
        for p in choice:
            shift, width = parts[p]
            k = F.shiftleft(k, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        return k

    entries = distinct.select("fp", F.posexplode(F.array(*[key(c) for c in choices])).alias("t", "k"))
    large = (entries.groupBy("t", "k").count().where(F.col("count") > chunk)
             .select("t", "k", F.ceil(F.col("count") / chunk).cast("int").alias("parts")))
    large = parked(large, "large-buckets")
    # lone members cannot link; members of large buckets go to every pair of chunks that holds their own
    own = F.pmod(F.hash("fp"), F.col("parts"))
    spread = (entries.join(large, ["t", "k"]).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("t", "k", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"),
                      F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "fp"))
    usual = entries.join(large, ["t", "k"], "left_anti").select(
        "t", "k", F.lit(0).alias("ci"), F.lit(0).alias("cj"), F.lit(2).alias("side"), "fp")

    def run(batches):
        for t in grouped_batches(batches, 4, 200_000):
            fps = np.asarray(t.column("fp")).view(np.uint64)
            u, v = bucket_links(fps, group_starts([t.column(i) for i in range(4)]), np.asarray(t.column("side")), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    batch_rows(distinct.sparkSession, NARROW_ROWS)
    met = usual.unionByName(spread).repartition("t", "k", "ci", "cj").sortWithinPartitions("t", "k", "ci", "cj")
    return met.mapInArrow(run, "u long, v long")


def clusters(prints: DataFrame, radius: int = 4, chunk: int = 4096) -> DataFrame:
    """(fp, root, component_id): the component of each fingerprint of ``prints`` (doc_id, fp), named
    by a fingerprint of it and by the smallest doc_id in it."""
    nodes = parked(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    found = components(links(nodes, nodes.count(), radius, chunk)).withColumnRenamed("node", "fp")
    rooted = parked(nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, chunk: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = parked(fingerprints(docs, id_col, text_col, shingle), "prints")
    return (prints.join(clusters(prints, radius, chunk), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each group: that with the smallest doc_id
    (null last; of repeated ids the row with the smallest row key)."""
    rows = keyed_rows(docs)
    wide = rows.select("_key", F.col(f"_row.{id_col}").alias("_id"), F.col(f"_row.{text_col}").alias("_text"))
    prints = parked(fingerprints(wide, "_id", "_text", shingle, key="_key"), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    stay = (prints.groupBy("fp").agg(best).join(clusters(prints, radius).select("fp", "root"), "fp")
            .groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("_key")))
    return one_of_each(rows.join(stay, "_key", "left_semi")).select("_row.*")
