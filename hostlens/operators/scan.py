"""Keyed running scans that stay balanced when one key holds most rows.

A ``Window.partitionBy(key)`` puts every row of a key into one task.  A host
or a file that holds a third of the data would then be sorted and scanned by a
single core.  ``keyed_scan`` instead

1. range-partitions the rows by ``(key, order...)`` with Spark's own range
   partitioner, so a hot key is cut into many similar slices, and writes them
   once with their slice number below the shared scratch folder: every branch
   of the plan, and every retry after a lost executor, reads the same slices;
2. aggregates that table to a summary per slice and derives what earlier
   slices carry into the first key of a slice;
3. adds the carry as one more row at the head of its slice (and a mark at the
   tail where a key goes on), places rows by slice number and runs the scan as
   a JVM window per ``(slice, key)``.  Nothing is broadcast.

The number of slices follows the counted rows (``hostlens.scan.sliceRows`` per
slice, one slice per core at least) and has no upper limit.  Range bounds hold
at most ``PREFIX`` characters of a text; longer texts with the same prefix stay
in one slice, and are told apart inside it.

Supported scans: running sums of integer columns and "last non-null value so
far" (fill down).  Both are inclusive of the current row.

Row ordinals need no scan (``ordinal``): slices are written sorted, with each
row's place in its slice, and what a (slice, key) adds to it comes from the
slices' counts.  So the rows are shuffled once, by range.

An input that is dear to compute (joins, aggregates, regular expressions, ...)
is written once first, as counting, sampling for the range bounds and
the shuffle each read it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.session import scratch_path

SLICE_ROWS = 200_000
PREFIX = 256
#: (slice, key) pairs up to this number go to the rows as a broadcast; more of them as a table that is joined.
BROADCAST_STARTS = 200_000
_DEAR = re.compile(r"\b(Join|Aggregate|Window|Generate|Expand|Sort|Union|Repartition\w*|MapIn\w+|\w*EvalPython|rlike|regexp_\w+)\b", re.I)
_INDEX = "_scan_index"
_KEY = "_scan_key"
_PART = "_scan_part"
_ROLE = "_scan_role"        # -1 carry at the head of a slice, 0 data, 1 mark at its tail


def slice_count(df: DataFrame) -> int:
    """Slices for the rows of ``df``, which are counted."""
    spark = df.sparkSession
    rows = int(spark.conf.get("hostlens.scan.sliceRows", str(SLICE_ROWS)))
    return max(spark.sparkContext.defaultParallelism, -(-df.count() // max(1, rows)))


def _range_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Sort columns of bounded width in the same order: a long text is cut, and what
    follows a cut text is left out, as its order depends on the rest of the text."""
    out, exact = [], F.lit(True)
    for name in names:
        c = F.col(name)
        if not isinstance(df.schema[name].dataType, T.StringType):
            out.append(F.when(exact, c))
            continue
        cut = F.coalesce(F.length(c) > PREFIX, F.lit(False))
        out += [F.when(exact, F.substring(c, 1, PREFIX)), F.when(exact, cut)]
        exact = exact & ~cut
    return out


def computed_once(df: DataFrame) -> DataFrame:
    """``df``, written to the scratch folder first if its plan does more than read and project."""
    if not _DEAR.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    return _stored(df, "scan-input")


def _stored(df: DataFrame, name: str) -> DataFrame:
    plain = [F.col(f"`{f.name}`").cast("string").alias(f"c{i}") if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`").alias(f"c{i}")
             for i, f in enumerate(df.schema.fields)]
    stored, path = df.select(*plain), scratch_path(df.sparkSession, name)
    stored.write.parquet(path)
    back = df.sparkSession.read.schema(stored.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(df.schema.fields)])


def sliced(df: DataFrame, sort_names: Sequence[str], n: int, index: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with its slice number, written once: slices are contiguous in the sort order.  ``index``
    names a column for the row's place in its sorted slice; ``drop`` are columns for the sort alone."""
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if f.name not in drop]
    plain = [F.col(f"`{f.name}`").cast("string").alias(f"c{i}") if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`").alias(f"c{i}")
             for i, f in enumerate(fields)]
    ranged = df.repartitionByRange(n, *_range_columns(df, sort_names))
    more = [F.spark_partition_id().alias(_PART)]
    if index:
        ranged = ranged.sortWithinPartitions(*sort_names)
        more.append(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(index))
    stored = ranged.select(*plain, *more)
    path = scratch_path(spark, "slices")
    stored.write.parquet(path)
    back = spark.read.schema(stored.schema).parquet(path)
    return back.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)], _PART, *([index] if index else []))


def keyed_scan(df: DataFrame, key: Column | str | None, order: Sequence[Column | str], *,
               sums: dict[str, Column] | None = None,
               fills: dict[str, Column | str] | None = None,
               befores: dict[str, Column | str] | None = None,
               partitions: int | None = None, mark_last: str | None = None) -> DataFrame:
    """Add running-sum and fill-down columns within ``key`` ordered by ``order``.

    ``sums``  name -> integer expression; output column ``name`` is the
              inclusive running sum within the key.
    ``fills`` name -> expression; output column ``name`` is the last non-null
              value within the key up to and including the row.
    ``befores`` the same, up to but not including the row.
    ``partitions`` fixes the slice count; by default it follows the row count.
    ``mark_last`` names a boolean output column that is true on the last row
    of each key.
    ``key=None`` scans the whole frame (one logical key).
    ``order`` must be a total order (include a unique tiebreak).
    """
    sums = dict(sums or {})
    befores = dict(befores or {})
    fills = {**dict(fills or {}), **befores}
    key_col = F.lit(0) if key is None else (F.col(key) if isinstance(key, str) else key)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]

    # all inputs are evaluated against the caller's columns before any is named
    made = {_KEY: key_col}
    made |= {"_in_" + name: F.coalesce(expr.cast("long"), F.lit(0)) for name, expr in sums.items()}
    made |= {"_in_" + name: F.col(expr) if isinstance(expr, str) else expr for name, expr in fills.items()}
    ords = [f"_sk{i}" for i in range(len(order_cols))]
    made |= dict(zip(ords, order_cols))
    base = computed_once(df.withColumns(made))
    n = partitions or slice_count(base)
    data = sliced(base, [_KEY, *ords], n)

    # what earlier slices carry into a slice's first key
    kstruct = F.struct(F.col(_KEY))
    at = F.struct(*[F.col(c) for c in ords])
    # rows are placed by slice number: values such as texts are aggregated by sorting, here one slice at a time
    narrow = data.select(_PART, _KEY, *ords, *["_in_" + c for c in [*sums, *fills]]).repartitionById(n, _PART)
    per_key = narrow.groupBy(_PART, _KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum("_in_" + s).alias("s_" + s) for s in sums],
        *[F.max_by("_in_" + f, F.when(F.col("_in_" + f).isNotNull(), at)).alias("f_" + f) for f in fills])
    per_part = per_key.groupBy(_PART).agg(
        F.min(kstruct).alias("first_k"), F.max(kstruct).alias("last_k"),
        *[F.max_by("s_" + s, kstruct).alias("s_" + s) for s in sums],
        *[F.max_by("f_" + f, kstruct).alias("f_" + f) for f in fills])
    # one row per slice from here on
    same_last = Window.partitionBy("last_k").orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)
    by_part = Window.orderBy(_PART)
    total = per_part.withColumns({**{"s_" + s: F.sum("s_" + s).over(same_last) for s in sums},
                                  **{"f_" + f: F.last("f_" + f, ignorenulls=True).over(same_last) for f in fills}})
    linked = total.select(
        _PART, "first_k", "last_k",
        F.lag("last_k").over(by_part).eqNullSafe(F.col("first_k")).alias("_joins"),
        F.lead("first_k").over(by_part).eqNullSafe(F.col("last_k")).alias("_goes_on"),
        *[F.lag("s_" + s).over(by_part).alias("_in_" + s) for s in sums],
        *[F.lag("f_" + f).over(by_part).alias("_in_" + f) for f in fills])
    inputs = [*["_in_" + s for s in sums], *["_in_" + f for f in fills]]
    head = linked.where("_joins").select(_PART, F.col(f"first_k.{_KEY}").alias(_KEY), F.lit(-1).alias(_ROLE), *inputs)
    tail = linked.where("_goes_on").select(_PART, F.col(f"last_k.{_KEY}").alias(_KEY), F.lit(1).alias(_ROLE))
    extra = head.unionByName(tail, allowMissingColumns=True) if mark_last else head

    # the scan per (slice, key); rows are placed by slice number
    placed = (data.withColumn(_ROLE, F.lit(0)).unionByName(extra, allowMissingColumns=True)
              .repartitionById(n, _PART))
    sort = [F.col(_ROLE), *[F.col(c).asc_nulls_first() for c in ords]]
    whole = Window.partitionBy(_PART, _KEY).orderBy(*sort)
    run = whole.rowsBetween(Window.unboundedPreceding, 0)
    prior = whole.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({**{s: F.sum("_in_" + s).over(run) for s in sums},
                              **{f: F.last("_in_" + f, ignorenulls=True).over(prior if f in befores else run) for f in fills},
                              **({mark_last: F.lead(F.lit(True)).over(whole).isNull()} if mark_last else {})})
    return out.where(F.col(_ROLE) == 0).drop(_KEY, _PART, _ROLE, *ords, *inputs)


def ordinal(df: DataFrame, key: Column | str | None, order: Sequence[Column | str],
            name: str = "rn", partitions: int | None = None, total: str | None = None) -> DataFrame:
    """0-based row position within ``key`` (or the frame) by ``order``; ``total`` names a column
    for the number of rows of the key."""
    key_col = F.lit(0) if key is None else (F.col(key) if isinstance(key, str) else key)
    # columns are sorted by as they are, expressions by a column that is not written
    made = {f"_sk{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
    base = computed_once(df.withColumns({_KEY: key_col, **made}))
    n = partitions or slice_count(base)
    data = sliced(base, [_KEY, *[o if isinstance(o, str) else f"_sk{i}" for i, o in enumerate(order)]], n, index=_INDEX, drop=list(made))
    # one row per slice and key: its first place in the slice, and the key's rows in earlier slices
    runs = data.groupBy(_PART, _KEY).agg(F.count(F.lit(1)).alias("_n"), F.min(_INDEX).alias("_first"))
    path = scratch_path(df.sparkSession, "slice-counts")
    runs.write.parquet(path)
    runs = df.sparkSession.read.schema(runs.schema).parquet(path)
    by_key = Window.partitionBy(_KEY)
    before = F.coalesce(F.sum("_n").over(by_key.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col(_PART).alias("_p"), F.col(_KEY).alias("_k"), (before - F.col("_first")).alias("_base"), F.sum("_n").over(by_key).alias("_total"))
    if runs.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    out = data.join(starts, (F.col(_PART) == F.col("_p")) & F.col(_KEY).eqNullSafe(F.col("_k")))
    out = out.withColumn(name, F.col("_base") + F.col(_INDEX))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(_KEY, _PART, _INDEX, "_p", "_k", "_base", *(["_total"] if total != "_total" else []))
