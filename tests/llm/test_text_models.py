"""Packing, SentencePiece, token counts, toxicity and licenses."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hostlens.llm import licenses, packing, sentencepiece_bpe, token_counts, toxicity
from hostlens.llm.queries import bpe_encoder, piece_model
from hostlens.session import scratch_path
from tests.conftest import SF, SMALL
from tests.llm.helpers import no_docs, odd_docs


# ---- packing ----

@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abc <|endoftext|>\n\t'sréé日😀 0.,", max_size=200))
def test_encoder_gives_the_ids_of_the_json_file(reference_tokenizer, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert bpe_encoder()(text).tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids


def _check_pieces(rows, docs, tokenizer, longest=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        if len(want[d]) == 1:       # repeated ids are checked by their sums
            ids, at = np.array(want[d][0], "<u4"), 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, want[d]))
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= longest and all(p.sequence_length == at for p in pieces)
        padded += 0 if at & (at - 1) == 0 else longest - at
    return padded


def test_packing_of_the_small_table(spark, reference_tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    rows = packing.pack(docs, bpe_encoder, wave_tokens=20_000).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert _check_pieces(rows, texts, reference_tokenizer) == 0
    # few windows are short, and steps of a tier hold about as many tokens
    sizes = defaultdict(int)
    for s in {r.sequence_id: r.sequence_length for r in rows}.values():
        sizes[s] += 1
    assert sizes[2048] >= 0.9 * sum(k * v for k, v in sizes.items()) / 2048 / 1.2


def test_packing_odd_cases(spark, reference_tokenizer):
    docs = odd_docs(spark)
    rows = packing.pack(docs, bpe_encoder, longest=256, shortest=16, tokens_per_step=512).collect()
    assert _check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], reference_tokenizer, 256) == 0
    assert packing.pack(no_docs(spark), bpe_encoder).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, bpe_encoder, longest=1000)


def test_packer_routes_to_tiers_and_balances_steps():
    rng = random.Random(2)
    p = packing.Packer(256, 16, 1024, 0)
    sizes = [rng.choice([3, 9, 17, 30, 70, 150, 255, 700]) for _ in range(2000)]
    for d, n in enumerate(sizes):
        p.add(d, np.full(n, d, np.uint32))
        if d % 500 == 499:
            p.pack()
    p.close()
    rows = list(p.flush())
    assert sum(r[2] for r in rows) == sum(sizes)
    cost, tokens = defaultdict(int), defaultdict(int)
    for _, _, n, _, _, _, window, step in rows:
        cost[window, step] += n * n
        tokens[window, step] += n
    steps = sorted(s for w, s in tokens if w == 256)
    assert all(tokens[256, s] <= 1024 for s in steps)
    full = [cost[256, s] for s in steps if tokens[256, s] == 1024]
    assert max(full) <= 2 * min(full)


# ---- SentencePiece ----

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


CODEC = []


def codec():
    if not CODEC:
        CODEC.append(sentencepiece_bpe.Codec(piece_model()))
    return CODEC[0]


def test_held_words_are_bounded_in_bytes(monkeypatch):
    """Long runs without spaces are not kept, and the words that are kept stay under the bound."""
    import sentencepiece
    codec = sentencepiece_bpe.Codec(piece_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    monkeypatch.setattr(sentencepiece_bpe, "CACHE_BYTES", 40_000)
    rng = random.Random(5)
    for _ in range(6):
        texts = [" ".join("".join(rng.choices("abcdeéß日本", k=rng.choice([3, 5, 200, 3000]))) for _ in range(12)) for _ in range(8)]
        assert codec.encode_many(texts) == [sp.encode(t) for t in texts]
        assert all(len(w) <= sentencepiece_bpe.LONG for w in codec.words)
        assert codec.held == sum(map(sentencepiece_bpe._size, codec.words)) <= 40_000 + 100 * sentencepiece_bpe._size("x" * sentencepiece_bpe.LONG)



@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text(alphabet="abehtn  ▁\n\t\x00é日0.<s>", max_size=120), min_size=1, max_size=5))
def test_pieces_equal_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = codec().encode_many(texts)
    assert ids == library.encode(texts)
    assert [codec().decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_long_words_and_runs_equal_the_library(library):
    rng = random.Random(8)
    texts = [" " * n + "x" for n in range(100)] + ["=" * 500, "ab" * 700 + "a" * 333, "".join(rng.choice("aeiouthsnr") for _ in range(5000))]
    texts += ["".join(rng.choice(["the", "in", "g", "er", "▁", "日本", "的"]) for _ in range(800)) for _ in range(20)]
    assert codec().encode_many(texts) == library.encode(texts)


def test_round_trip_query(spark, library):
    docs = odd_docs(spark)
    got = sentencepiece_bpe.round_trip(docs, piece_model).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(want, key=repr)
    assert sentencepiece_bpe.round_trip(no_docs(spark), piece_model).count() == 0


# ---- token counts ----

def _totals(store):
    return sorted([tuple(r) for r in store.totals().collect()], key=repr)


def test_rollup_follows_inserts_revisions_and_deletes(spark):
    counters = {"words@1": token_counts.word_count, "chars@1": lambda t: F.length(F.coalesce(t, F.lit(""))).cast("long")}
    store = token_counts.RollupStore(spark, scratch_path(spark, "rollup-test"))
    assert store.totals().count() == 0
    docs = odd_docs(spark)
    assert store.commit("b1", token_counts.changes(docs, "insert", counters))
    first = _totals(store)
    unique = {}
    for r in docs.collect():
        key = r.doc_id if r.doc_id is not None else ("text", r.text or "")
        unique[key] = r
    want = defaultdict(lambda: [0, 0])
    for r in unique.values():
        w = want[r.source, r.lang, "words@1"]
        w[0] += 1
        w[1] += len((r.text or "").split())
    assert sorted([(r[0], r[1], r[2], r[3], r[4]) for r in first if r[2] == "words@1"], key=repr) == sorted([(*k, *v) for k, v in want.items()], key=repr)
    # the same batch again, as after a restart, counts once
    assert not store.commit("b1", token_counts.changes(docs, "insert", counters))
    assert _totals(store) == first
    # a revision replaces, a delete takes back, unknown deletes and repeats change nothing
    new = spark.createDataFrame([(1, "one two", "fr", "z")], "doc_id long, text string, lang string, source string")
    gone = spark.createDataFrame([(9, "x", "en", "a"), (777, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    batch = token_counts.changes(new, "revise", counters).unionByName(token_counts.changes(gone, "delete", counters, seq=1))
    assert store.commit("b2", batch)
    totals = {r[:3]: r[3:] for r in _totals(store)}
    assert totals["z", "fr", "words@1"] == (1, 2)
    before = {r[:3]: r[3:] for r in first}
    assert totals["a", "en", "words@1"] == (before["a", "en", "words@1"][0] - 2, before["a", "en", "words@1"][1] - 5 - 3)
    assert store.commit("b3", token_counts.changes(gone, "delete", counters))
    assert {r[:3]: r[3:] for r in _totals(store)} == totals
    assert store.commit("b4", token_counts.changes(no_docs(spark), "insert", counters))
    assert {r[:3]: r[3:] for r in _totals(store)} == totals


def test_a_broken_commit_is_not_seen(spark):
    store = token_counts.RollupStore(spark, scratch_path(spark, "rollup-test"))
    doc = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    real = store._publish
    store._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.commit("b", token_counts.changes(doc, "insert", {"words@1": token_counts.word_count}))
    assert store.totals().count() == 0
    store._publish = real
    assert store.commit("b", token_counts.changes(doc, "insert", {"words@1": token_counts.word_count}))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "words@1", 1, 2)]


def test_rows_without_an_id_count_each(spark):
    rows = [(None, "a b", "en", "s")] * 3 + [(None, "a b", "de", "s"), (1, "c", "en", "s"), (1, "c", "en", "s"), (1, "d e", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    store = token_counts.RollupStore(spark, scratch_path(spark, "rollup-test"))
    store.commit("b", token_counts.changes(docs, "insert", {"words@1": token_counts.word_count}))
    assert _totals(store) == [("s", "de", "words@1", 1, 2), ("s", "en", "words@1", 4, 8)]
    key = token_counts.row_key(*[F.col(c) for c in ("doc_id", "text", "source", "lang")])
    store = token_counts.RollupStore(spark, scratch_path(spark, "rollup-test"))
    each = docs.withColumn("row_key", key)
    store.commit("b", token_counts.changes(each, "insert", {"words@1": token_counts.word_count}, key_col="row_key"))
    assert _totals(store) == [("s", "de", "words@1", 1, 2), ("s", "en", "words@1", 6, 10)]
    store.commit("c", token_counts.changes(each.where("text = 'c'"), "delete", {"words@1": token_counts.word_count}, key_col="row_key"))
    assert _totals(store) == [("s", "de", "words@1", 1, 2), ("s", "en", "words@1", 4, 8)]


# ---- toxicity ----

def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(got[d].predicted, t) for d, t in truth.items() if d in got and got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert sum(p == t for p, t in test) >= 0.93 * len(test)
    assert not any(p for p, t in test if t == 0)
    assert model.label_model is not None and np.allclose(np.diag(model.label_model.correlation), 1, atol=0.2)


def test_held_out_labels_are_never_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.weights == b.weights and a.bias == b.bias


def test_toxicity_odd_cases(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None), (2, 0)], "doc_id long, toxic int")
    for labels in (none, one_class):
        model = toxicity.train(docs, labels)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
        assert model.score("you are a stupid worthless idiot") >= 0.5 > model.score(None)
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(no_docs(spark), model).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    def voter(hit, miss):
        return np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < miss).astype(float)
    a, b, c = voter(0.8, 0.05), voter(0.7, 0.1), voter(0.6, 0.02)
    votes = np.stack([a, b, c, c], axis=1)       # the last two are the same voter
    m = toxicity.fit_label_model(votes, np.clip(votes.sum(axis=1) / 3, 0.05, 0.95))
    assert abs(m.speaks[1, 0] - 0.8) < 0.1 and abs(m.speaks[0, 0] - 0.05) < 0.07
    assert m.correlation[2, 3] > 0.8 and m.weight[2] < 0.7 and m.weight[0] > 0.75
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.85



def test_strongest_patterns_are_kept(spark):
    rows = [(f"{'mild' if i < 30 else ''} {'fits' if i < 25 else ''} w{i}", 1) for i in range(40)] + [(f"{'mild' if i < 20 else ''} c{i}", 0) for i in range(400)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    assert toxicity.mine(sample, most=1)[0] == ["fits"] and toxicity.mine(sample)[0] == ["mild", "fits"]


# ---- licenses ----

def _best_cover(template, words):
    """Most template words in order within any stretch of bounded length (brute force)."""
    n = len(template)
    best = 0
    for a in range(len(words)):
        best = max(best, len(licenses.common(template, words[a:a + n + n // 4 + 2])))
    return best / n


def test_licenses_against_brute_force(spark):
    rng = random.Random(6)
    filler = "sun moon river the of license version and software work under".split()
    short = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 100}
    rows, want = [], {}
    for d in range(120):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 40))]
        if d % 2:
            t = licenses.words_of(rng.choice(list(short.values())))
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(["x", "y"])
            at = rng.randint(0, len(words))
            words[at:at] = t
        rows.append((d, " ".join(words)))
        want[d] = {k for k, v in short.items() if _best_cover(licenses.words_of(v), words) >= 0.8}
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), short).collect():
        got[r.doc_id].add(r.license)
    assert sum(map(len, want.values())) > 25
    assert all(got[d] == want[d] for d in want)


def test_license_spans_copies_and_odd_cases(spark):
    mit = licenses.TEMPLATES["mit"]
    text = f"intro\n{mit}\n\noutro {mit.upper()} Released under the MIT License. Released under the MIT License."
    known = licenses.compiled(licenses.TEMPLATES, 0.8)
    found = licenses.matches(text, known, 0.8)
    assert [m[0] for m in found] == ["mit", "mit", "mit-notice", "mit-notice"]
    assert text[found[0][1]:found[0][2]] == mit.rstrip(".") and found[0][3] == 1.0
    assert licenses.matches(text.replace("merge, publish", "mix"), known, 0.8)[0][3] < 1
    docs = odd_docs(spark)
    assert licenses.scan(docs).count() == 0 and licenses.scan(no_docs(spark)).count() == 0


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        p = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in p) and p == sorted(p) and len({i for i, _ in p}) == len(p) == len({j for _, j in p})
        assert len(p) <= len(licenses.common(a, b))


def test_each_license_is_found_under_its_own_name_only():
    known = licenses.compiled(licenses.TEMPLATES, 0.8)
    for name, text in licenses.TEMPLATES.items():
        found = {m[0]: m[3] for m in licenses.matches(text, known, 0.8)}
        assert found.pop(name) == 1.0 and set(found) <= {"apache-2.0-notice"}, (name, found)
    bsd, isc = licenses.TEMPLATES["bsd-2-clause"], licenses.TEMPLATES["isc"]
    for cut in (bsd[:bsd.index("THIS SOFTWARE")], isc[:isc.index("IN NO EVENT")]):
        assert all(m[3] < 1 for m in licenses.matches(cut, known, 0.8))
