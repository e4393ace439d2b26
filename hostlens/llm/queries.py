"""The registered queries over the corpus tables, with their SQL where SQL can say it.

Each query applies its operator with production parameters to the whole table
and derives the columns of its contract from the operator's results.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm import (chat, digests, exact_dedup, hard_negatives, html_wrappers, licenses, max_sketch, packing, pq_links, sentencepiece_bpe,
                          simhash, token_counts, toxicity)
from hostlens.llm.common import TEXT_ROWS, batch_rows, table
from hostlens.llm.exact_dedup import SIEVE_BITS, sieve, sift
from hostlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# ---- the tokenizer files; the tasks look their places up for themselves ----

def bpe_encoder():
    """Byte-level BPE of ``byte_bpe_50k.json`` (the same vocabulary as ranks, five times as fast), with its special token."""
    import public_tokenizers
    return packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _bpe_lengths(texts: pd.Series) -> pd.Series:
    encode = bpe_encoder()
    return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")


def bpe_count(text: Column) -> Column:
    """Token counts under the byte-level BPE."""
    return F.pandas_udf(_bpe_lengths, T.LongType())(text)


# ---- queries ----

@query("op1_exact_dedup", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
     g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k,
                  first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM g""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _rollup(spark: SparkSession, sf_dir: str, counters: dict) -> DataFrame:
    """Load all documents; then take back those labelled toxic and revise the count of those of low
    quality (digits removed); then commit both batches again, which must change nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    batch_rows(spark, TEXT_ROWS)
    store = token_counts.RollupStore(spark, scratch_path(spark, "token-counts"))
    # each row of the table is a document, as in the SQL, also rows without an id or with a repeated one
    key = token_counts.row_key(*[F.col(c) for c in ("doc_id", "text", "source", "lang")])
    load = token_counts.changes(docs.withColumn("row_key", key), "insert", counters, key_col="row_key")
    marked = labels.where("toxic = 1 or quality = 0")
    # a bit table of the marked ids filters the scan, so that only about their texts are moved to meet the labels
    near = sift(docs, ["doc_id"], sieve(marked, ["doc_id"], SIEVE_BITS), SIEVE_BITS).where("_shared").drop("_shared")
    touched = near.join(marked, "doc_id").withColumn("row_key", key)
    gone = token_counts.changes(touched.where("toxic = 1"), "delete", {v: lambda t: F.lit(0).cast("long") for v in counters}, seq=1, key_col="row_key")
    cleaned = touched.where("coalesce(toxic, 0) = 0").withColumn("text", F.regexp_replace("text", "[0-9]+", ""))
    for _ in range(2):
        store.commit("load", load)
        store.commit("labels", gone.unionByName(token_counts.changes(cleaned, "revise", counters, key_col="row_key")))
    return store.totals()


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, {"byte_bpe_50k@1": bpe_count, "words@1": token_counts.word_count})


@query("op3_word_counts", r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
     d AS (SELECT source, lang, CASE WHEN quality = 0 THEN regexp_replace(coalesce(text, ''), '[0-9]+', '', 'g')
                                     ELSE coalesce(text, '') END AS text
           FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(toxic, 0) = 0)
SELECT source, lang, 'words@1' AS tokenizer, count(*) AS docs,
       CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM d GROUP BY source, lang""")
def op3_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, {"words@1": token_counts.word_count})


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_encoder)


@query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


@query("op6_embedding_links", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS w FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.w, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.w, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_links.linked_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query("op9_chat_format", r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(regexp_replace(text, '<(~*)\|', '<~\1|', 'g')) + 12 + 1 + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), probe.alias("text"))
        for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    chats = chat.format_chats(chat.rows_to_records(rows.unionByName(extra)), F.col("conv_id"), F.col("record"))
    # read back from the formatted text and its loss runs
    back = chats.select(F.col("key").alias("conv_id"), F.length("formatted").cast("long").alias("formatted_chars"),
                        chat.read_back(F.col("formatted")).alias("turns"),
                        F.array_join(chat.under_loss(F.col("formatted"), F.col("loss_runs")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), piece_model, keep_ids=False)


@query("op11_lexical_search", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
     c AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
     s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM c),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
     x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN f USING (term) JOIN c USING (doc_id), s GROUP BY item_id, doc_id),
     r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
           FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                  CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
           FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
                        AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), number % 50 == 0, label=label)
