"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. *Voters.*  Word and word-start patterns that are significantly tied to the
   toxic label are mined from a sample of labelled documents and joined to
   families (a pattern and those it contains); each large family is a lexicon
   voter, the small ones vote together.  Fixed voters add general insults in
   several languages and patterns (an insult aimed at the reader, dense
   insults), and one votes clean when nothing else speaks.
2. *Label model.*  A latent class model estimates how often each voter speaks
   in either class by expectation maximisation over the votes; the given label
   of a row is one more voter, of a fixed accuracy (``GOLD``).  Voters that
   stay correlated within a class (their residual correlation is estimated from
   the posteriors) share their weight, so that near-copies are not counted
   twice.
3. *Classifier.*  Logistic regression on the patterns is fitted to the posterior
   labels; it alone scores documents.

Fitting reads at most ``fit_rows`` labelled documents (a documented bound; a
sample by hash of doc_id, never rows held out; equal texts count once); mining and voting run on Spark,
the driver sees pattern counts and votes of that sample.  Within it, patterns
of fewer than 3 toxic documents, or than a 200th of them, are not looked at, the
2,048 patterns with the strongest tie are kept, and the 48 first families are
voters of their own, all others one voter.  Scoring covers every document and
its whole text.

Defined results: a null text counts as empty; an empty text scores like a text
without any pattern; without labelled rows, or with labels of one class, the
fixed voters alone decide; several labels of one doc_id count as toxic if one
is; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import TEXT_ROWS, batch_rows, map_batches, parked

#: General insults, per language.
INSULTS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash garbage worthless pathetic disgusting clown filthy vermin imbecile dumb",
    "de": "idiot dummkopf abschaum trottel wertlos erbärmlich widerlich versager müll arschloch",
    "fr": "idiot imbécile ordure abruti crétin pathétique dégoûtant minable raclure stupide",
    "es": "idiota imbécil basura escoria estúpido patético asqueroso perdedor payaso inútil",
}
#: Words that address the reader.
SECOND_PERSON = "you your you're du dich euch vous toi tu usted ustedes"
WORD = re.compile(r"\w+")
STARTS = (4, 5, 6)
#: Accuracy of the given labels as a voter.
GOLD = 0.95
FIXED = ["fixed:insult", "fixed:two insults", "fixed:insult to the reader", "fixed:dense insults"]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def patterns_of(words: list[str]) -> set[str]:
    """Whole words, and starts of longer words (``lowe*``)."""
    out = set(words)
    for w in list(out):
        for k in STARTS:
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


def fixed_votes(words: list[str]) -> list[str]:
    insults = _INSULTS
    at = [i for i, w in enumerate(words) if w in insults]
    if not at:
        return []
    out = [FIXED[0]]
    if len({words[i] for i in at}) > 1:
        out.append(FIXED[1])
    if any(words[j] in _READER for i in at for j in range(max(0, i - 3), min(len(words), i + 4))):
        out.append(FIXED[2])
    if len(at) * 50 >= len(words):
        out.append(FIXED[3])
    return out


_INSULTS = {w for v in INSULTS.values() for w in v.split()}
_READER = set(SECOND_PERSON.split())


@dataclass
class LabelModel:
    """P(voter speaks | class) per voter, class prior, discounts for correlated voters."""
    prior: float
    speaks: np.ndarray          # 2 x voters: clean, toxic
    weight: np.ndarray          # per voter
    correlation: np.ndarray     # voters x voters, within classes

    def posterior(self, votes: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """P(toxic | votes) of each row of ``votes`` (0 or 1), with the log-odds ``more`` of other voters."""
        on, off = np.log(self.speaks), np.log1p(-self.speaks)
        each = votes @ ((on[1] - on[0]) * self.weight) + (1 - votes) @ ((off[1] - off[0]) * self.weight)
        return 1 / (1 + np.exp(-np.clip(each + more + log(self.prior / (1 - self.prior)), -50, 50)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, times: np.ndarray | None = None, more: np.ndarray | float = 0.0,
                    turns: int = 20) -> LabelModel:
    """Expectation maximisation from the first posterior ``start``; then once more with
    the discounts that the residual correlations call for.  ``times`` counts equal rows; ``more``
    are log-odds of voters whose accuracy is known."""
    times = np.ones(len(votes)) if times is None else times.astype(float)
    n, v = times.sum(), votes.shape[1]
    weight, correlation = np.ones(v), np.eye(v)
    for _ in range(2):
        post = start.copy()
        for _ in range(turns):
            toxic, clean = post * times, (1 - post) * times
            prior = float(np.clip((toxic.sum() + 1) / (n + 2), 1e-3, 0.999))
            speaks = np.stack([(clean @ votes + 0.05) / (clean.sum() + 0.1), (toxic @ votes + 0.05) / (toxic.sum() + 0.1)])
            model = LabelModel(prior, np.clip(speaks, 1e-4, 1 - 1e-4), weight, correlation)
            post, before = model.posterior(votes, more), post
            if np.abs(post - before).max() < 1e-6:
                break
        mean = np.outer(1 - post, model.speaks[0]) + np.outer(post, model.speaks[1])
        rest = votes - mean
        cov = (rest * times[:, None]).T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = cov / np.outer(sd, sd)
        weight = 1 / np.maximum(1, np.clip(correlation, 0, 1).sum(axis=1))
    return LabelModel(model.prior, model.speaks, weight, correlation)


def fit_logistic(hits: list[list[int]], size: int, y: np.ndarray, times: np.ndarray, ridge: float = 0.3, turns: int = 2000) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels ``y`` of rows that hold the features ``hits``, ``times`` each.
    Accelerated gradient steps over the held features only."""
    each = times / times.sum()
    lengths = np.fromiter(map(len, hits), np.int64, len(hits))
    row, col = np.repeat(np.arange(len(hits)), lengths), np.fromiter((c for h in hits for c in h), np.int64, int(lengths.sum()))
    w, b = np.zeros(size), 0.0
    vw, vb = w.copy(), b
    rate = 4.0 / (1 + lengths.max(initial=0) / 4)
    for t in range(turns):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, vw[col], len(hits)) + vb, -50, 50)))
        gap = each * (p - y)
        nw = vw - rate * (np.bincount(col, gap[row], size) + ridge * vw / times.sum())
        nb = vb - rate * gap.sum()
        vw, vb = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


@dataclass
class Classifier:
    """A linear score over patterns; ``voters`` and ``label_model`` tell how it came about."""
    weights: dict[str, float]
    bias: float
    voters: list[list[str]] = field(default_factory=list)
    label_model: LabelModel | None = None

    def score(self, text: str | None) -> float:
        words = words_of(text)
        known = self.weights
        total = self.bias + sum(known.get(x, 0.0) for x in fixed_votes(words))
        for w in set(words):
            total += known.get(w, 0.0)
            for k in STARTS:
                if len(w) > k:
                    total += known.get(w[:k] + "*", 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves remainder 0 by 5 (a null id as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _tie(a: int, b: int, na: int, nb: int) -> float:
    """How a pattern of ``a`` toxic and ``b`` clean documents is tied to the toxic class: the likelihood
    ratio; 0 unless ten times as frequent there, and a ratio beyond chance for a million patterns."""
    if a / na < 10 * (b + 0.3) / nb:
        return 0.0
    p = (a + b) / (na + nb)
    g = a * log(a / na / p) + (b * log(b / nb / p) if b else 0.0)
    return 2 * g if 2 * g >= 24 else 0.0


def mine(sample: DataFrame, most: int = 2048) -> tuple[list[str], int, int]:
    """The patterns of ``sample`` (text, toxic) that are tied to toxic documents, most frequent first;
    where they are more than ``most``, those with the strongest tie."""
    spark = sample.sparkSession

    def counted(only: set[str] | None):
        def run(b: pa.RecordBatch) -> list:
            seen: Counter = Counter()
            for t in b.column(0).to_pylist():
                p = patterns_of(words_of(t))
                seen.update(p & only if only is not None else p)
            return [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
        return run

    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    na, nb = totals.get(1, 0), totals.get(0, 0)
    if not na or not nb:
        return [], na, nb
    least = max(3, na // 200)
    bad = map_batches(sample.where("toxic = 1").select("text"), "p string, n long", counted(None)).groupBy("p").agg(F.sum("n").alias("n"))
    often = {r.p: r.n for r in bad.where(F.col("n") >= least).toLocalIterator()}
    only = spark.sparkContext.broadcast(set(often))

    def clean(b: pa.RecordBatch) -> list:
        return counted(only.value)(b)

    good = {r.p: r.n for r in map_batches(sample.where("toxic = 0").select("text"), "p string, n long", clean)
            .groupBy("p").agg(F.sum("n").alias("n")).toLocalIterator()}
    found = {p: tie for p, a in often.items() if (tie := _tie(a, good.get(p, 0), na, nb))}
    strongest = sorted(found, key=lambda p: (-found[p], len(p), p))[:most]
    return sorted(strongest, key=lambda p: (-often[p], len(p), p)), na, nb


def families(patterns: list[str], largest: int = 48) -> list[list[str]]:
    """Patterns joined to the first earlier one they contain or are contained in; small families vote together."""
    out: list[list[str]] = []
    for p in patterns:
        stem = p.rstrip("*")
        home = next((f for f in out if stem.startswith(f[0].rstrip("*")[:4]) and (f[0].endswith("*") or p.endswith("*"))), None)
        if home is None:
            out.append([p])
        else:
            home.append(p)
    return out[:largest] + ([[p for f in out[largest:] for p in f]] if len(out) > largest else [])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          fit_rows: int = 20_000) -> Classifier:
    """Fit on at most ``fit_rows`` labelled documents that are not held out."""
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    share = min(1.0, fit_rows / max(1, n))
    # a sample by hash, the same whatever the order of the rows; the limit only guards the documented bound, which makes the broadcast safe
    some = (known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
            .orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(fit_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = parked(texts.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    patterns, na, nb = mine(sample)
    voters = families(patterns)
    names = FIXED + patterns
    shared = spark.sparkContext.broadcast({p: i for i, p in enumerate(names)})

    def hits(b: pa.RecordBatch) -> list:
        at = shared.value
        out = []
        for t in b.column(0).to_pylist():
            words = words_of(t)
            out.append(sorted(at[p] for p in patterns_of(words).union(fixed_votes(words)) if p in at))
        return [pa.array(out, pa.list_(pa.int32())), b.column(1)]

    rows = map_batches(sample.select("text", "toxic"), "hits array<int>, toxic int", hits).groupBy("hits", "toxic").count().collect()
    if not na or not nb:
        return Classifier({FIXED[0]: 2.0, FIXED[1]: 3.0, FIXED[2]: 2.0, FIXED[3]: 2.0}, -3.0)
    found = [r.hits for r in rows]
    times = np.array([r["count"] for r in rows], float)
    # pattern -> its voters; a fixed pattern is a voter of its own
    voice = {i: i for i in range(len(FIXED))}
    place = {p: i for i, p in enumerate(names)}
    for k, family in enumerate(voters):
        voice |= {place[p]: len(FIXED) + k for p in family}
    votes = np.zeros((len(rows), len(FIXED) + len(voters) + 1))
    for k, hit in enumerate(found):
        votes[k, [voice[h] for h in hit]] = 1
    votes[:, -1] = votes[:, :-1].max(axis=1) == 0       # the clean voter
    given = np.array([r.toxic for r in rows])
    gold = np.where(given == 1, 1, -1) * log(GOLD / (1 - GOLD))
    model = fit_label_model(votes, np.where(given == 1, GOLD, 1 - GOLD), times, gold)
    w, b = fit_logistic(found, len(names), model.posterior(votes, gold), times)
    return Classifier({p: float(v) for p, v in zip(names, w) if v}, b, voters, model)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(b: pa.RecordBatch) -> list:
        one = shared.value.score
        return [b.column(0), b.column(1), pa.array([one(t) for t in b.column(2).to_pylist()], pa.float64())]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return (map_batches(rows, "doc_id long, held_out boolean, score double", run)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index(text_col)

    def run(batches):
        one = shared.value.score
        for b in batches:
            keep = pa.array([one(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_())
            yield b.filter(keep)

    batch_rows(docs.sparkSession, TEXT_ROWS)
    return docs.mapInArrow(run, docs.schema)
