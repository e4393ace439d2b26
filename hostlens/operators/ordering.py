"""Natural ordering, pages of rows, filtered-out counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.functions.natural import natural_key
from hostlens.operators.scan import computed_once, ordinal, slice_count


def natural_rank(df: DataFrame, col: str, tiebreak: str, name: str = "rank", strip_html: bool = False,
                 case_insensitive: bool = False) -> DataFrame:
    """O1-O3: 0-based rank in natural order (raw text, then ``tiebreak`` settle ties).

    The rank is computed by a range-partitioned scan, not a single-task window; the sort key
    is not written.
    """
    key = natural_key(col, strip_html=strip_html, case_insensitive=case_insensitive)
    return ordinal(df, None, [key, col, tiebreak], name=name)


def natural_sort(df: DataFrame, col: str, tiebreak: str, **kw) -> DataFrame:
    """Rows sorted naturally (global sort by the key)."""
    key = natural_key(col, **kw)
    return df.orderBy(key, F.col(col), F.col(tiebreak))


def page(df: DataFrame, order: Sequence[Column | str], tiebreak: str, offset: int, size: int) -> DataFrame:
    """Multi-column order with a unique tiebreak, then one page."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order] + [F.col(tiebreak)]
    return df.orderBy(*cols).offset(offset).limit(size)


class OrderedPages:
    """O4 for many pages of one order: the rows sorted once into slices, and a directory of the slices' bounds.
    A page reads the one or two slices it lies in, be it the first or the millionth."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def store(cls, df: DataFrame, order: Sequence[Column | str], tiebreak: str, root: str, slices: int | None = None) -> OrderedPages:
        """Sort ``df`` (``order``, then the unique ``tiebreak``) and store it below ``root``."""
        made = cls(df.sparkSession, root)
        cols = [F.col(o) if isinstance(o, str) else o for o in order] + [F.col(tiebreak)]
        base = computed_once(df)
        sorted_ = base.repartitionByRange(slices or slice_count(base), *cols).sortWithinPartitions(*cols)
        (sorted_.select(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id().alias("_slice"),
                        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
         .write.partitionBy("_slice").parquet(f"{made.root}/rows"))
        counts = made._rows().groupBy("_slice").count()
        before = F.sum("count").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))      # one row per slice
        counts.select("_slice", F.coalesce(before, F.lit(0)).alias("start"), "count").write.parquet(f"{made.root}/directory")
        return made

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows ``offset`` to ``offset + size`` in order, with their 0-based ``position``."""
        at = (self.spark.read.parquet(f"{self.root}/directory").where((F.col("start") < offset + size) & (F.col("start") + F.col("count") > offset))
              .orderBy("_slice").collect())
        start = F.lit(None).cast("long")
        for r in at:
            start = F.when(F.col("_slice") == r["_slice"], F.lit(r.start)).otherwise(start)
        rows = self._rows().where(F.col("_slice").isin([r["_slice"] for r in at])).withColumn("position", start + F.col("_place"))
        return rows.where((F.col("position") >= offset) & (F.col("position") < offset + size)).orderBy("position").drop("_slice", "_place")


def filtered_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """Total, shown and filtered-out counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(predicate).alias("n_shown")) \
        .withColumn("n_filtered_out", F.col("n_total") - F.col("n_shown"))
