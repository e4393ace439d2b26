"""Token counts as delta-maintained rollups.

A store below one folder holds, per committed batch, signed ledger rows (doc,
tokenizer version, source, language, +1 or -1 documents, +n or -n tokens) and
their sums per (source, language, tokenizer version).  Totals are the sum of
the committed sums, so a batch costs what it changes: an insert adds a row, a
delete takes the document's present rows back, a revision does both.  What a
document counts at present is itself the sum of its ledger rows, so a deletion
of an unknown document, or a second one, changes nothing.

A batch is written to folders of its own attempt and becomes visible through
one numbered commit; a batch id that is already committed is left alone, so a
repeated or restarted commit counts once.  A writer that finds its number taken
reads the new commits and does its batch again, so concurrent batches take each
row back once.

Defined results: changes of one batch to one (doc_id, tokenizer) are reduced to
the last by ``seq``, so repeated rows of one doc_id count once; with keys of
``row_key`` each row of a batch counts, also equal ones.  Rows with a null doc_id
are keyed by text, source and language and always count one by one; a later
batch with such a row says anew how many there are.  An insert of a known
document is a revision; null source and language are groups of their own; a null
text has no tokens; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.commits import CommitLog

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_key string, source string, lang string, tokenizer string, docs long, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


class RollupStore:
    """Signed ledgers and additive totals below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._log = CommitLog(spark, f"{self.root}/commits")

    def committed(self) -> dict[str, str]:
        """Committed batch ids and the attempts that hold them."""
        return dict(n.split("@", 1) for n in self._log.entries())

    def _read(self, what: str, schema: str, committed: dict[str, str] | None = None) -> DataFrame:
        committed = self.committed() if committed is None else committed
        paths = [f"{self.root}/{what}/{b}@{a}" for b, a in sorted(committed.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups without documents are gone."""
        return (self._read("sums", TOTALS).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs != 0 or tokens != 0"))

    def present(self, asked: DataFrame | None = None, committed: dict[str, str] | None = None) -> DataFrame:
        """What each document counts at present, per tokenizer version; only those of ``asked`` (doc_key, tokenizer)."""
        rows = self._read("ledger", LEDGER, committed)
        if asked is not None:
            rows = rows.join(asked, ["doc_key", "tokenizer"], "left_semi")
        return (rows.groupBy("doc_key", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs != 0 or tokens != 0"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op: insert, revise or delete; doc_key, each_row, source, lang,
        tokenizer, tokens, seq) once; False if the batch was committed before, also by another
        writer meanwhile."""
        if not batch_id or set(batch_id) & set("@/"):
            raise ValueError("a batch id has no @ or /")
        while True:
            committed = self.committed()
            if batch_id in committed:
                return False
            attempt = self._prepare(batch_id, changes, committed)
            # what was taken back is what these commits hold: another commit since then, and it is done again
            if self._publish(len(committed) + 1, batch_id, attempt):
                return True

    def _publish(self, number: int, batch_id: str, attempt: str) -> bool:
        return self._log.claim(number, f"{batch_id}@{attempt}")

    def _prepare(self, batch_id: str, changes: DataFrame, committed: dict[str, str]) -> str:
        """Write the batch's ledger and sums, as they follow on ``committed``; returns the attempt."""
        attempt = uuid.uuid4().hex[:12]
        last = (changes.groupBy("doc_key", "tokenizer").agg(F.max(F.struct("seq", "op", "tokens", "source", "lang")).alias("c"),
                                                            F.count_if(F.col("each_row") & (F.col("op") != "delete")).alias("n"))
                .select("doc_key", "tokenizer", "c.*", F.greatest("n", F.lit(1).cast("long")).alias("docs")))
        added = last.where("op != 'delete'").select("doc_key", "source", "lang", "tokenizer", "docs",
                                                     (F.coalesce(F.col("tokens").cast("long"), F.lit(0)) * F.col("docs")).alias("tokens"))
        signed = added
        if committed:
            touched = last.select("doc_key", "tokenizer")
            taken = (self.present(touched, committed)
                     .select("doc_key", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
            signed = added.unionByName(taken)
        ledger = f"{self.root}/ledger/{batch_id}@{attempt}"
        signed.write.parquet(ledger)
        sums = (self.spark.read.schema(LEDGER).parquet(ledger).groupBy(*GROUP)
                .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        sums.write.parquet(f"{self.root}/sums/{batch_id}@{attempt}")
        return attempt


def doc_key(doc_id: Column, text: Column, source: Column, lang: Column) -> Column:
    """The id as text; rows without an id by the digest of what they count."""
    row = F.to_json(F.struct(text.alias("text"), source.alias("source"), lang.alias("lang")))
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("row:"), F.sha2(F.encode(row, "UTF-8"), 256)))


def row_key(doc_id: Column, text: Column, source: Column, lang: Column) -> Column:
    """A key that tells rows of one id apart, for tables in which each row is a document."""
    cols = [x for c in (text, source, lang) for x in (c.isNull(), c)]      # hashes pass over nulls
    return F.concat(doc_key(doc_id, text, source, lang), F.lit("#"), F.hex(F.xxhash64(*cols)))


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def changes(docs: DataFrame, op: str, counters: dict[str, Callable[[Column], Column]], seq: int = 0, id_col: str = "doc_id",
            text_col: str = "text", source_col: str = "source", lang_col: str = "lang", key_col: str | None = None) -> DataFrame:
    """One change per row and tokenizer version; ``counters`` maps versions to expressions of the text.
    ``key_col`` holds keys of ``row_key``, of the rows as they were first inserted."""
    text, source, lang = (F.col(c).cast("string") for c in (text_col, source_col, lang_col))
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), count(text).alias("tokens")) for v, count in counters.items()])
    known = doc_key(F.col(id_col), text, source, lang) if key_col is None else F.col(key_col)
    return (docs.select(known.alias("doc_key"), (F.col(id_col).isNull() if key_col is None else F.lit(True)).alias("each_row"),
                        source.alias("source"), lang.alias("lang"), F.explode(each).alias("t"))
            .select(F.lit(op).alias("op"), "doc_key", "each_row", "source", "lang", "t.tokenizer", "t.tokens", F.lit(seq).cast("long").alias("seq")))
