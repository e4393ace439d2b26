"""Ranked lexical search with hashed max-sketches.

Terms are the maximal runs of ASCII letters and digits and of all characters
from U+0080 on, in the whole text, with only A-Z lower-cased.  With N documents
that hold a term, L terms in them and n terms in one document, a document's
length factor is ``m = 100 - 50 + (50 n N) div L``, a term's impact in it is
``(10^9 tf) div (1000 tf + 20 m)``, and a term that df documents hold weighs
``floor(1000 ln((2 N + 2) / (2 df + 1)))``.  A document's score for a query is
the sum of weight times impact over the query's distinct terms, in integers.

Two scans of the texts.  The first counts N, L and the df of the queries'
terms.  The second folds each document's impacts into a sketch: a term's hash
names one of ``width`` coordinates, and a coordinate holds the largest impact
that falls on it.  The impact of a term is therefore at most what its
coordinate holds, and one table look-up per query term, for a batch of
documents at once, gives upper bounds of all scores.  Per query the documents of
a batch are scored exactly in the order of falling bounds, until the next bound
is under the k-th best score so far.  The bounds never fall short, so the
result is exact for every width; the width only decides how many documents are
scored.

A task keeps k documents per query; the tasks' lists merge as in ``best``.  Queries go to the tasks in blocks of at most
``BLOCK_BYTES`` of text (or one query, where that is longer), each block in
scans of its own, so the broadcast is bounded however many queries there are.

Defined results: null and empty texts have no terms; documents that score 0 for a
query are left out; equal scores rank by ascending id, null ids last, and rows that
repeat an id and a text rank one by one; each row of the queries is a query, also
one that repeats an id or has none; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.best import merged, schema, task_rows
from hostlens.llm.common import TEXT_ROWS, batch_rows, parked

WIDTH = 4096
#: Text of the queries that one pair of scans answers, and so the bound of its broadcasts.
BLOCK_BYTES = 4 << 20
#: Documents and text whose sketches and counts are held at a time.
FOLD_ROWS, FOLD_BYTES = 512, 8 << 20
DOCS, TERMS = -1, -2
NO_ID = -(1 << 63)

#: Bytes of UTF-8 that belong to terms, with A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 50 + 50 * n * n_docs // n_terms


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def fold(counts: list[Counter], m: list[int], width: int, column: np.ndarray, columns: int) -> np.ndarray:
    """Sketches of documents (columns x documents): the largest impact on each coordinate that
    ``column`` gives a place (others have -1)."""
    out = np.zeros((columns, len(counts)))
    sizes = np.fromiter(map(len, counts), np.int64, len(counts))
    total = int(sizes.sum())
    at = np.fromiter((crc32(t) for c in counts for t in c), np.int64, total) & (width - 1)
    at = column[at]
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, total)
    doc = np.repeat(np.arange(len(counts)), sizes)
    held = at >= 0
    at, tf, doc = at[held], tf[held], doc[held]
    np.maximum.at(out, (at, doc), impact(tf, np.array(m, np.int64)[doc]))
    return out


class Queries:
    """A block of queries: their weighted terms and the sketch coordinates that these fall on."""

    def __init__(self, texts: list[bytes], df: dict[bytes, int], n_docs: int, n_terms: int, k: int, width: int):
        self.n_docs, self.n_terms, self.k, self.width = n_docs, n_terms, k, width
        self.weights = []
        for text in texts:
            held = {t: weight(n_docs, df[t]) for t in set(terms(text)) if t in df}
            self.weights.append({t: w for t, w in held.items() if w > 0})
        places = sorted({crc32(t) & (width - 1) for w in self.weights for t in w})
        self.columns = len(places)
        self.column = np.full(width, -1, np.int64)
        self.column[places] = np.arange(len(places))

    def lookups(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query its sketch columns and their weights."""
        return [(self.column[np.array([crc32(t) & (self.width - 1) for t in w], np.int64)], np.array(list(w.values()), np.float64)) for w in self.weights]

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of a task for each query, one row per query."""
        lookups, best = self.lookups(), [[] for _ in self.weights]
        for b in batches:
            for ids, texts in _portions(b):
                counts = [Counter(terms(t)) for t in texts]
                m = [length_factor(c.total(), self.n_docs, self.n_terms) for c in counts]
                sketch = fold(counts, m, self.width, self.column, self.columns)
                for (cols, w), weights, heap in zip(lookups, self.weights, best):
                    if len(cols):
                        self._rescore(w @ sketch[cols], weights, heap, ids, counts, m)
        found = [(q, *e) for q, heap in enumerate(best) for e in sorted(heap, reverse=True)]
        slot, score, place = (np.array(c, np.int64) for c in (zip(*found) if found else ((), (), ())))
        yield task_rows(slot, {"score": score, "place": place}, self.k)

    def _rescore(self, bounds: np.ndarray, weights: dict[bytes, int], heap: list, ids: list, counts: list[Counter], m: list[int]) -> None:
        """Exact scores in the order of falling bounds, until the next bound is under the k-th best."""
        full = len(heap) == self.k
        at = np.flatnonzero(bounds >= heap[0][0] if full else bounds > 0)
        for i in at[np.argsort(-bounds[at], kind="stable")].tolist():
            if full and bounds[i] < heap[0][0]:
                return
            held, mi, score = counts[i], m[i], 0
            for t, w in weights.items():
                tf = held.get(t)
                if tf:
                    score += w * impact(tf, mi)
            if score > 0:
                # the complement of the id falls as the id rises; rows without an id come last
                entry = (score, NO_ID if ids[i] is None else ~ids[i])
                if not full:
                    heapq.heappush(heap, entry)
                    full = len(heap) == self.k
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def _portions(b: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a batch in portions of bounded rows and bytes (or one text)."""
    ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= FOLD_ROWS or size + len(t or b"") > FOLD_BYTES):
            yield ids[at:i], texts[at:i]
            at, size = i, 0
        size += len(t or b"")
    if at < len(texts):
        yield ids[at:], texts[at:]


def _statistics(texts: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int, int]:
    """(df of the held terms, N, L) over all documents; the vocabulary is a block's."""
    words = sorted(vocabulary)
    sent = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(words)})

    def count(batches):
        place, df, n_docs, n_terms = sent.value, Counter(), 0, 0
        known = place.keys()
        for b in batches:
            for t in b.column(0):
                held = terms(t.as_py())
                n_docs += bool(held)
                n_terms += len(held)
                df.update(known & set(held))
        at = [DOCS, TERMS, *(place[t] for t in df)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([n_docs, n_terms, *df.values()], pa.int64())], names=["term", "n"])

    found = dict(texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    return {words[i]: n for i, n in found.items() if i >= 0}, found.get(DOCS, 0), found.get(TERMS, 0)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
           query_id_col: str = "item_id", query_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of every query: item_id, rank, doc_id, score.  ``width`` is a power of two."""
    spark = docs.sparkSession
    batch_rows(spark, TEXT_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = parked(queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_id_col).alias("item_id"),
                                  F.col(query_text_col).cast("string").cast("binary").alias("text")), "queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        ranked = _ranked(texts, part.select("q", "text").orderBy("q").collect(), k, width)
        out = ranked if out is None else out.unionByName(ranked)
    return (out.join(asked.select("q", "item_id"), "q")
            .select("item_id", F.col("rank"), F.when(F.col("place") != NO_ID, F.bitwise_not("place")).alias("doc_id"), "score"))


def _ranked(texts: DataFrame, rows: list, k: int, width: int) -> DataFrame:
    """(q, rank, place, score) for one block of queries."""
    spark = texts.sparkSession
    vocabulary = {t for r in rows for t in terms(r.text)}
    df, n_docs, n_terms = _statistics(texts, vocabulary)
    sent = spark.sparkContext.broadcast(Queries([r.text for r in rows], df, n_docs, max(1, n_terms), k, width))
    found = parked(texts.mapInArrow(lambda batches: sent.value.search(batches), schema(["score", "place"])), "best-of-tasks")
    # one row per query of the block
    names = spark.createDataFrame([(i, r.q) for i, r in enumerate(rows)], "slot int, q long")
    return merged(found, k).join(F.broadcast(names), "slot").select("q", "rank", "place", "score")
