"""Improbable-feature digests against a plain restatement."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hostlens.llm import digests as D
from tests.conftest import SMALL
from tests.llm.helpers import no_docs, odd_docs


def _bin(window):
    s = sum(round(c * math.log2(c) * 1024) for c in Counter(window).values())
    most = round(D.WINDOW * math.log2(D.WINDOW) * 1024)
    return 1000 - (1000 * s + most // 2) // most


def _hash(window):
    mask, h = (1 << 64) - 1, 0x9E3779B97F4A7C15
    for k in range(0, D.WINDOW, 8):
        h = (h ^ int.from_bytes(window[k:k + 8], "little")) * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 29
    h = h * 0x94D049BB133111EB & mask
    return h ^ h >> 32


def _windows(t):
    return [t[i:i + D.WINDOW] for i in range(len(t) - D.WINDOW + 1)] or [t.ljust(D.WINDOW, b"\0")] if t else []


def _chain(t, rank):
    ws = _windows(t)
    key = [(int(rank[_bin(w)]), i) for i, w in enumerate(ws)]
    got = Counter(min(key[i:i + D.STRETCH])[1] for i in range(len(key)))
    least = next((p for p in D.POINTS if sum(n >= p for n in got.values()) >= D.ENOUGH), 1)
    hashes = list(dict.fromkeys(_hash(ws[i]) for i in sorted(got) if got[i] >= least))
    out = []
    for a in range(0, len(hashes), D.PER_FILTER):
        bits = np.zeros(D.BITS, np.uint8)
        for h in hashes[a:a + D.PER_FILTER]:
            bits[[h >> 11 * k & D.BITS - 1 for k in range(D.HASHES)]] = 1
        out.append(np.packbits(bits))
    return np.array(out, np.uint8).reshape(-1, D.BITS // 8)


def _overlap(a, b):
    s, t, e = (sum(x.bit_count() for x in v) for v in (a.tolist(), b.tolist(), (a & b).tolist()))
    c = s * t / D.BITS + 3 * math.sqrt(s * t / D.BITS * (1 - s / D.BITS) * (1 - t / D.BITS))
    return max(0.0, (e - c) / (min(s, t) - c)) if min(s, t) > c else 0.0


def _likeness(a, b):
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    one = lambda a, b: np.average([max(_overlap(x, y) for y in b) for x in a], weights=[sum(v.bit_count() for v in x.tolist()) for x in a])
    return (one(a, b) + one(b, a)) / 2 if len(a) == len(b) else one(*sorted((a, b), key=len))


def _order(rows):
    """Falling ids, rows without one last."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def _check(rows, got, rank):
    """``rows`` (doc_id, text) in the order of the result's neighbours."""
    want = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        e = t[:len(t) - k] + following[:k]
        a, b, c = (_chain(x.encode(), rank) for x in (t, e, following))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), D.as_text(a), D.as_text(b), round(_likeness(a, b), 9), round(_likeness(a, c), 9)))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=repr) == sorted(want, key=repr)


def test_query_against_a_plain_restatement(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.length("text") < 4000)
    rows = _order([(r.doc_id, r.text or "") for r in docs.collect()])
    counts = np.bincount([_bin(w) for _, t in rows for w in _windows(t.encode())], minlength=D.BINS)
    rank = D.rarity(docs)
    assert (rank == D.ranks(counts)).all()
    for size in (D.RANGE_BYTES, 10_000):     # one range per core, many ranges
        got = D.fingerprints(docs.repartition(7), range_bytes=size)
        assert [f"{c} {t}" for c, t in got.dtypes] == [f.replace("long", "bigint") for f in D.FINGERPRINTS.split(", ")]
        _check(rows, got.collect(), rank)


def test_likeness_of_edits_and_strangers(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = D.fingerprints(docs).collect()
    assert len(got) == docs.count()
    long = [r for r in got if r.n_chars > 400]
    assert np.quantile([r.near_edited for r in long], 0.05) > 0.35 > np.quantile([r.near_next for r in long], 0.95)


def test_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, a lone row, no rows."""
    docs = odd_docs(spark)
    rank = D.ranks(np.zeros(D.BINS, np.int64))
    got = D.fingerprints(docs, rank=rank).collect()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted((r.doc_id, len(r.text)) for r in rows if r.doc_id is not None)
    assert len({r.fingerprint for r in got if r.n_chars == len("same words here")}) == 1
    assert all((r.fingerprint == "") == (r.n_chars == 0) for r in got)
    line = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    edits = [D.edited(a.text, b.text) for a, b in zip(line, line[1:] + line[:1])]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)
    assert D.fingerprints(no_docs(spark)).count() == 0
    one, = D.fingerprints(docs.where("doc_id = 1")).collect()
    assert one.near_next == 1.0 and one.fingerprint


def test_pieces_and_portions_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcdefgh \n", k=rng.choice([0, 1, 5, 31, 32, 33, 95, 96, 300, 5000]))) for _ in range(40)]
    rank = D.ranks(D.entropy_counts(texts))
    whole = [D.as_text(c) for c in D.chains(texts, rank)]
    assert whole == [D.as_text(_chain(t, rank)) for t in texts]
    monkeypatch.setattr(D, "PIECE", 100)
    assert [D.as_text(c) for c in D.chains(texts, rank)] == whole
    assert all((D.from_text(f) == c).all() for f, c in zip(whole, D.chains(texts, rank)))
