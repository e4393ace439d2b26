"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after deleting the characters
``[\\x20\\x09-\\x0D]``.  Each level keeps only rows whose key so far is shared
with another row; the full text is digested only for rows that pass the last
level.  A level's shared keys go to the scan as a *sieve*: a bit table of fixed
size (``2 ** sieve_bits`` bits, a documented bound that does not grow with the
data), so texts are filtered where they are read and never shuffled.  A key
that is let through by a shared bit is a lone row in the last grouping, so the
result is exact at any table size.

Defined results: a null text counts as empty; of equal texts the row with the
most code points in its original text stays, then the smallest doc_id (null
ids last), then any one of rows that are equal in all that; an empty table
gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.identity import row_key
from hostlens.llm.common import keyed_rows, one_of_each, parked

#: The deleted characters (fixed by the contract).
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a sieve, and so the bound of its broadcast: 65,536 rows of 64 bits.
SIEVE_BITS = 22


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sieve(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """Bit table of the key values: at most 2 ** (bits - 6) rows of 64 bits."""
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    return (keys.select((F.shiftright(h, 6)).alias("_word"), F.expr("1L").alias("_one"), F.pmod(h, F.lit(64)).cast("int").alias("_bit"))
            .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_mask")))


def sift(df: DataFrame, columns: list[str], table: DataFrame, bits: int) -> DataFrame:
    """``df`` with a boolean column ``_shared``: whether the key's bit is set."""
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    return (df.withColumn("_word", F.shiftright(h, 6))
            .withColumn("_bit", F.pmod(h, F.lit(64)).cast("int"))
            .join(F.broadcast(table), "_word", "left")
            .withColumn("_shared", F.coalesce(F.expr("getbit(_mask, _bit) = 1"), F.lit(False)))
            .drop("_word", "_bit", "_mask"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256,
                sieve_bits: int = SIEVE_BITS, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, row_key, sha256 (null for rows
    whose text was not read in full, unless ``digest_all``), keep_id, group_size, kept.

    ``row_key`` is a 128-bit hash of all columns of the row, to find it again.
    """
    ident = row_key(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), ident.alias("row_key"))
    rows = rows.withColumn("_norm", normalised(F.col("_text")))
    keyed = rows.select("doc_id", "row_key", "_norm", F.octet_length("_norm").alias("n_bytes"),
                        F.length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_chars"))
    # 1. length
    lengths = parked(keyed.groupBy("n_bytes").count(), "lengths")
    by_length = sieve(lengths.where("count > 1"), ["n_bytes"], sieve_bits)
    # 2. prefix hash, of rows that share their length
    prefix = F.xxhash64(F.substring("_norm", 1, prefix_chars))
    level2 = sift(keyed, ["n_bytes"], by_length, sieve_bits).where("_shared").select("n_bytes", prefix.alias("prefix_hash"))
    shared = parked(sieve(level2.groupBy("n_bytes", "prefix_hash").count().where("count > 1"),
                          ["n_bytes", "prefix_hash"], sieve_bits), "prefixes")
    # 3. full hash, of rows that share length and prefix
    level3 = sift(keyed.withColumn("prefix_hash", prefix), ["n_bytes", "prefix_hash"], shared, sieve_bits)
    digest = F.sha2(F.encode("_norm", "UTF-8"), 256)
    seen = parked(level3.select("doc_id", "row_key", "n_bytes", "n_chars", F.col("_shared").alias("shared"),
                                (digest if digest_all else F.when(F.col("_shared"), digest)).alias("sha256"),
                                F.monotonically_increasing_id().alias("uid")), "digests")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("best")
    groups = (seen.where("shared").groupBy("n_bytes", "sha256").agg(F.count("*").alias("group_size"), best)
              .where("group_size > 1").select("n_bytes", "sha256", "group_size", F.col("best.doc_id").alias("keep_id"),
                                              F.col("best.uid").alias("keep_uid")))
    # written, so that the join below is between two plain exchanges and Spark can split the rows of a large group
    groups = parked(groups, "groups")
    return (seen.join(groups, ["n_bytes", "sha256"], "left")
            .select("doc_id", "n_chars", "row_key", "sha256",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with the columns of ``docs``."""
    stay = find_copies(docs, id_col, text_col).where("kept").select(F.col("row_key").alias("_key")).distinct()
    return one_of_each(keyed_rows(docs).join(stay, "_key", "left_semi")).select("_row.*")
