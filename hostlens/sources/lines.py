"""Text files to ``(file, line_no, line)`` rows.

Line order inside a file is (split start, position inside the split); the
numbering is a keyed scan per file, so one huge file is numbered by many
tasks, not one.

Many small files are listed and read by few tasks: Spark lists folders in up to
10,000 tasks, whatever the cores, and reads 32 small files per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.scan import ordinal


#: Tasks per core that list folders, and that read files of up to so many bytes each; beyond that, more tasks read.
CORE_TASKS = 4
READ_BYTES = 32 << 20
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _text(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    cores, most = spark.sparkContext.defaultParallelism, spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(most), CORE_TASKS * cores)))
    try:
        return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)     # lists the files
    finally:
        spark.conf.set(_LISTING, most)


def raw_lines(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """Lines with their file and a read-order position (no numbering yet)."""
    df = _text(spark, list(paths) if isinstance(paths, (list, tuple)) else [paths], recursive)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(CORE_TASKS * spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    lines = df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"),
                     F.regexp_replace(F.col("value"), "\r$", "").alias("line"))
    return lines.coalesce(tasks)        # larger files have fewer tasks than this anyway


def read_lines(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """``(file, line_no, line)`` with ``line_no`` from 0 in file order."""
    df = raw_lines(spark, paths, recursive)
    out = ordinal(df, "file", [F.col("_block"), F.col("_mid")], name="line_no")
    return out.select("file", "line_no", "line")


def text_lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Lines of a long text column: ``(key, line_no, line)`` by ``posexplode(split)``."""
    return df.select(F.col(key), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
