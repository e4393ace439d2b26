"""The pipeline against its stages done by hand, and the SQL of the corpus queries."""

import itertools

import pytest

from hostlens.llm import packing, toxicity
from hostlens.llm.queries import QUERIES, SQL, bpe_encoder
from tests.conftest import SF, SMALL
from tests.llm.helpers import no_docs, odd_docs, union_find
from tests.llm.test_dedup import _fingerprint_by_hand, _plain


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    left = [r for r in docs.collect() if model.score(r.text) < 0.5]
    groups = {}
    for r in left:
        groups.setdefault(_plain(r.text), []).append(r)
    left = [min(g, key=lambda r: (-len(r.text), r.doc_id)) for g in groups.values()]
    fp = {r.doc_id: _fingerprint_by_hand(r.text, 4) for r in left}
    find = union_find((a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4)
    want = {r.doc_id: len(bpe_encoder()(r.text)) + 1 for r in left if find(r.doc_id) == r.doc_id}
    got = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_on_odd_and_empty_tables(spark):
    import corpus_pipeline
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "packing" or out.columns == docs.columns
            out.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    from tools.compare import _rows, duck
    cur = duck(SF).execute(SQL[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, cur.fetchall())


def test_contract_columns_of_packing():
    assert [c.split()[0] for c in packing.PIECES.split(", ")][:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
