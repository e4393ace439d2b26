"""Session construction and the shared scratch location.

Scratch data (rendered fixtures, versioned tables) lives under the folder the
cluster names in ``spark.checkpoint.dir``.  A folder of our own is only set
when that setting is absent, which is the case in local tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "hostlens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        # one machine: list folders on the driver instead of launching a listing job
        # (clusters keep Spark's default, which parallelises listing of large remote stores)
        conf["spark.sql.sources.parallelPartitionDiscovery.threshold"] = "100000"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a folder of this machine; on a
    cluster that would be a folder per machine, so it is an error there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hostlens-ckpt-"))
        d = sc.getCheckpointDir()
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused sub-folder of the scratch root."""
    root = scratch_root(spark)
    return f"{root}/hostlens/{name}-{uuid.uuid4().hex[:12]}"


def num_partitions(spark: SparkSession, n: int | None = None) -> int:
    return int(n or spark.conf.get("spark.sql.shuffle.partitions"))
