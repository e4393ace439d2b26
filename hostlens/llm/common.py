"""Shared pieces of the corpus operators: scratch tables, row keys, batches, components.

Scratch tables go below the folder that the cluster names in
``spark.checkpoint.dir``; they cut lineage, so an executor that is lost costs
at most the stage that runs at that moment.
"""

from __future__ import annotations

import itertools
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.functions.identity import row_key
from hostlens.session import scratch_path

#: Rows per Arrow batch sent to a Python worker: of texts, which may be long, and of narrow rows.
TEXT_ROWS, NARROW_ROWS = 500, 10_000
_OWN_ROWS: dict[str, int] = {}


def parked(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed (as ``--py-files`` does)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        package = Path(__file__).parent.parent
        name = Path(tempfile.mkdtemp(prefix="ship-")) / "corpus_operators.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(name))


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Before Python runs on executors: send the package there, and set the session's Arrow batch
    size to ``rows``, or to the user's own where that is smaller."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = _OWN_ROWS.setdefault(spark.sparkContext.applicationId, int(spark.conf.get(key)))
    spark.conf.set(key, str(min(own, rows) if own > 0 else rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_rows(df: DataFrame) -> DataFrame:
    """(_key, _row): the row key, and the row as one struct, so that no name can clash."""
    return df.select(row_key(df).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of rows with the same ``_key`` (rows repeated as a whole) one; they are counted by key alone."""
    twice = parked(rows.groupBy("_key").count().where("count > 1").select("_key"), "repeats")
    if not twice.take(1):
        return rows
    again = rows.join(twice, "_key", "left_semi").dropDuplicates(["_key"])
    return rows.join(twice, "_key", "left_anti").unionByName(again)


def map_batches(df: DataFrame, schema: str | T.StructType, fn: Callable, rows: int = TEXT_ROWS) -> DataFrame:
    """``fn(pyarrow.RecordBatch) -> list of arrays`` over the batches of ``df``, of ``rows`` at most."""
    batch_rows(df.sparkSession, rows)
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(fn(b), names=names)

    return df.mapInArrow(run, schema)


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Regroup batches sorted by their first ``keys`` columns into tables of about
    ``rows`` rows that never cut a group.  A table holds one whole group at least."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            cut = group_starts([t.column(i) for i in range(keys)])[-1]
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut)
            held, n = t.combine_chunks().to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def group_starts(columns: list) -> np.ndarray:
    """Row numbers where a new group of the sorted key columns starts (integers, no nulls)."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        v = np.asarray(c)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def star_labels(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable in the two-sided graph ``linked`` (len(a) x len(b) booleans)."""
    la, lb = a.copy(), b.copy()
    i, j = np.nonzero(linked)
    while len(i):
        was_a, was_b = la.copy(), lb.copy()
        np.minimum.at(la, i, lb[j])
        np.minimum.at(lb, j, la[i])
        if np.array_equal(was_a, la) and np.array_equal(was_b, lb):
            break
    return la, lb


def star_edges(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most len(a) + len(b) links that join the same nodes as all of ``linked``."""
    la, lb = star_labels(linked, a, b)
    u, v = np.concatenate([a, b]), np.concatenate([la, lb])
    keep = u != v
    return u[keep], v[keep]


def _is_star(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has exactly one link, to a centre."""
    ends = (edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                                           F.struct(F.col("v").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
                         .alias("e")).select("e.*"))
    bad = (ends.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
           .where("a > 1 or (a = 1 and b > 0)"))
    return not bad.take(1)


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components: (node, root), root being the smallest id of the component.

    Large-star and small-star rounds (Kiveris et al., "Connected components in
    MapReduce and beyond") over aggregates and equi-joins, so that no node's
    links are gathered in one place.  Each round is a written table.  Only
    nodes with a link to another node are returned; null ends are left out.
    """
    a, b = F.col(u), F.col(v)
    edges = parked(links.where(a.isNotNull() & b.isNotNull() & (a != b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    for turn in itertools.count():
        if _is_star(edges):
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
                                              F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = parked(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(),
                       f"large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                         .alias("e")).select("e.*").where("u != v").distinct())
        edges = parked(small, f"small-{turn}")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
