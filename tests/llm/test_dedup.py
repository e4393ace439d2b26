"""Exact and SimHash near-duplicates, and components, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hostlens.llm import exact_dedup, simhash
from hostlens.llm.common import components
from tests.conftest import SMALL
from tests.llm.helpers import LONG, no_docs, odd_docs, union_find


def _plain(text):
    return "".join(c for c in (text or "") if c not in " \t\n\x0b\x0c\r")


def _exact_by_hand(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(_plain(t), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for i, (d, t) in enumerate(rows):
        g = sorted(groups[_plain(t)])
        keep = rows[g[0][3]][0]
        out.append((d, keep, len(g), hashlib.sha256(_plain(t).encode()).hexdigest()))
    return out


def test_exact_odd_cases(spark):
    docs = odd_docs(spark)
    got = exact_dedup.find_copies(docs, digest_all=True, sieve_bits=12).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = _exact_by_hand(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.sha256) for r in got], key=repr) == sorted(want, key=repr)
    # exactly one row of each group stays, repeated rows included
    kept = {}
    for r in got:
        kept[r.sha256] = kept.get(r.sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_exact_reads_in_full_only_shared_rows(spark):
    rows = [(i, f"text number {i} " + "x" * (i % 7)) for i in range(300)] + [(1000, "twice"), (1001, "twi ce")]
    got = exact_dedup.find_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    read = [r for r in got if r.sha256 is not None]
    assert {1000, 1001} <= {r.doc_id for r in read} and len(read) < 50
    assert [r.keep_id for r in got if r.doc_id == 1000] == [1001]       # the longer original stays
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id < 1000)


def test_exact_tiny_sieve_is_still_exact(spark):
    """A sieve whose bits are all set lets everything through and changes nothing."""
    docs = odd_docs(spark)
    a = exact_dedup.find_copies(docs, digest_all=True, sieve_bits=6).collect()
    b = exact_dedup.find_copies(docs, digest_all=True, sieve_bits=20).collect()
    pick = lambda rows: sorted([(r.doc_id, r.keep_id, r.group_size, r.sha256) for r in rows], key=repr)
    assert pick(a) == pick(b)


def test_drop_copies_keeps_columns_and_one_row_each(spark):
    docs = odd_docs(spark)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [_plain(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({_plain(r.text) for r in docs.collect()})


def test_empty_tables(spark):
    none = no_docs(spark)
    assert exact_dedup.find_copies(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).columns == none.columns
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _fingerprint_by_hand(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), seed=42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_hand():
    for text in [None, "", "one", "A b C", "a b c d", "a b c d a b c d e\x0bf\x0cg  h", "É é x y z w", LONG[:5000]]:
        assert simhash.fingerprint(text, 4) == _fingerprint_by_hand(text, 4), text


def test_fingerprint_matches_spark_hash(spark):
    """The same XXH64 as Spark's own."""
    text = "some four word text"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), seed=42)


def _near(rng, n, radius=4):
    """Random fingerprints with clusters, chains and lone ones."""
    fps = [rng.getrandbits(64) for _ in range(n // 2)]
    while len(fps) < n:
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, radius + 2)):
            f ^= 1 << b
        fps.append(f)
    return sorted(set(fps))


def test_bit_sliced_distances():
    rng = random.Random(3)
    fps = np.array(_near(rng, 300), np.uint64)
    words = simhash.planes(fps)
    for radius in (0, 1, 3, 4, 7):
        q = np.repeat(fps, words.shape[1])
        masks = simhash.within(q, words, np.tile(np.arange(words.shape[1]), len(fps)), radius)
        linked = np.unpackbits(masks.astype("<u8").view(np.uint8), bitorder="little").reshape(len(fps), -1)[:, :len(fps)]
        want = np.array([[int(a ^ b).bit_count() <= radius for b in fps.tolist()] for a in fps.tolist()])
        assert (linked.astype(bool) == want).all()


def test_links_join_the_same_components(spark):
    rng = random.Random(5)
    fps = _near(rng, 1500)
    dense = [fps[0] ^ sum(1 << b for b in c) for c in itertools.combinations(range(20), 2)]      # one large group
    fps = sorted({*fps, *dense})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    find = union_find((a, b) for (a, x), (b, y) in itertools.combinations(list(zip(signed, fps)), 2) if (x ^ y).bit_count() <= 4)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for n, chunk in ((len(fps), 4096), (len(fps), 64), (10**9, 4096)):       # short buckets, cut buckets, more parts
        roots = {r.node: r.root for r in components(simhash.links(df, n, 4, chunk)).collect()}
        assert all(roots.get(x, x) == find(x) for x in signed)


def test_near_duplicates_odd_cases_by_brute_force(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fp = [_fingerprint_by_hand(t, 4) for _, t in rows]
    find = union_find((a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    want = [(d, f"{fp[i]:016x}", first.get(find(i))) for i, (d, _) in enumerate(rows)]
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len({find(i) for i in range(len(rows))})


def test_near_duplicates_of_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, _fingerprint_by_hand(r.text, 4)) for r in docs.select("doc_id", "text").collect()]
    find = union_find((a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if (x ^ y).bit_count() <= 4)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", find(d)) for d, f in rows)


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 300)]
    other = [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)]
    pairs = chain + star + other + [(5, None), (None, 7), (8, 8), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    find = union_find((a, b) for a, b in pairs if a is not None and b is not None and a != b)
    nodes = {x for a, b in pairs if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
