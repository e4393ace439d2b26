"""The file inventory (name, size, time, path) and lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.kernels import upsert


def inventory(spark: SparkSession, paths, recursive: bool = True, name_parts: int = 1) -> DataFrame:
    """One row per file; only metadata columns are read (content is pruned).  The name is the
    last ``name_parts`` parts of the path, for folders in which names repeat."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(paths if isinstance(paths, (list, tuple)) else [paths]))
    return df.select(F.substring_index("path", "/", -name_parts).alias("filename"),
                     F.col("length").alias("filesize"),
                     F.col("modificationTime").cast("timestamp_ntz").alias("timestamp"),
                     F.col("path").alias("system_path"))


def refresh_inventory(current: DataFrame, scanned: DataFrame) -> DataFrame:
    """I8 upsert keyed by filename: new files inserted, known ones refreshed."""
    return upsert(current, scanned, "filename")


def inventory_lookup(inv: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Uploads by id as a join (never a driver-side dict)."""
    return inv.join(ids.select(id_col).distinct(), id_col, "inner")
