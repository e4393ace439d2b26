"""Per-host files, JSON rows with fixed date formats, table export."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.timefmt import JSON_DATE_FORMAT, JSON_TIMESTAMP_FORMAT


def file_name(template: str, host: Column) -> Column:
    """The per-host file name from a ``{hostname}`` template (no Python format per row)."""
    parts = template.split("{hostname}")
    out = F.lit(parts[0])
    for p in parts[1:]:
        out = F.concat(out, host, F.lit(p))
    return out


def write_per_host(df: DataFrame, out: str, host_col: str = "Hostname", template: str = "{hostname}",
                   fmt: str = "parquet") -> str:
    """One folder per host (``file_name=<template value>``), written in parallel.

    Hosts are not collected to the driver.  Rows are gathered by host before the
    write, so a host makes a few files, not one per task; a rebalance splits a
    large host over tasks, and ``maxRecordsPerFile`` bounds its files.
    """
    (df.withColumn("file_name", file_name(template, F.col(host_col))).hint("rebalance", "file_name")
     .write.mode("errorifexists").option("maxRecordsPerFile", 5_000_000)
     .partitionBy("file_name").format(fmt).save(out))
    return out


def _local_folder(spark: SparkSession, out: str) -> str | None:
    """The plain path of a folder on a local (or mounted) file system, else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_lines_per_host(lines: DataFrame, order: Sequence[str], out: str, partitions: int) -> str:
    """Text lines (``host``, ``value`` and the ``order`` columns) to one file per host, ``host=<host>/part-00000.txt``.

    A host's lines are sorted and written by one task; ``partitions`` is to follow the rows.  On mounted file
    systems the tasks write the files themselves, each under a hidden name that is renamed when the file is whole,
    so a task may run again: Spark's writer starts a process for every file there, and moves each file on the driver.
    """
    placed = (lines.repartition(partitions, "host").sortWithinPartitions("host", *[F.col(c).asc_nulls_first() for c in order])
              .select("host", "value"))
    root = _local_folder(lines.sparkSession, out)
    if root is None:
        placed.write.mode("errorifexists").partitionBy("host").text(out)
        return out
    os.makedirs(root)
    placed.mapInArrow(_host_files(root), "host string").write.format("noop").mode("overwrite").save()
    open(os.path.join(root, "_SUCCESS"), "w").close()
    return out


def _host_files(root: str):
    """A closure that imports what it needs, so that executors need not have this package."""

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        import pyarrow.compute as pc
        host, file, hidden = object(), None, None       # no host yet; null is one

        def folder(name):
            return os.path.join(root, "host=" + ("__HIVE_DEFAULT_PARTITION__" if name is None else name))

        def done():
            if file is not None:
                file.close()
                os.replace(hidden, os.path.join(folder(host), "part-00000.txt"))

        for b in batches:
            runs = pc.run_end_encode(b.column(0)) if len(b) else None
            at = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()) if runs is not None else ():
                if name != host:
                    done()
                    os.makedirs(folder(name), exist_ok=True)
                    host, hidden = name, os.path.join(folder(name), f".part-{uuid.uuid4().hex}")
                    file = open(hidden, "w", encoding="utf-8", newline="")
                file.writelines(("" if v is None else v) + "\n" for v in b.column(1).slice(at, end - at).to_pylist())
                at = end
        done()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["host"])

    return write


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text with ``MM-dd-yyyy HH:mm:ss`` times and ``yyyy-MM-dd`` dates."""
    opts = {"timestampFormat": JSON_TIMESTAMP_FORMAT, "timestampNTZFormat": JSON_TIMESTAMP_FORMAT,
            "dateFormat": JSON_DATE_FORMAT}
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), opts).alias(name))


def export_csv(df: DataFrame, out: str) -> str:
    """Table export as CSV with a header line."""
    df.write.mode("errorifexists").option("header", True).csv(out)
    return out
