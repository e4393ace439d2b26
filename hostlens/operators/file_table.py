"""K1, K3-K5 on a table of many files: only the files that hold touched keys are rewritten.

A version is a manifest: the table's data files with the smallest and largest
key and the rows of each.  Files are cut by key, and the file with the greatest
smallest key not above a key owns it (the first file owns all below), so every key
has one owner, also one that is not stored yet.  A change finds the owners of its keys,
reads and rewrites these files alone, and lists the others again.  The new manifest
becomes visible by a numbered commit; a writer that finds its number taken does its
change again on the version that was published, so no change is lost.

Files are plain parquet below one folder, never changed once written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators import kernels as K
from hostlens.operators.commits import CommitLog
from hostlens.operators.scan import keyed_scan

FILE_ROWS = 1_000_000
_OWNER, _OP = "_owner", "_op"


class FileTable:
    def __init__(self, spark: SparkSession, root: str, key: str, file_rows: int = FILE_ROWS):
        self.spark, self.root, self.key, self.file_rows = spark, root.rstrip("/"), key, file_rows
        self._log = CommitLog(spark, f"{self.root}/commits")

    # versions ---------------------------------------------------------------
    def version(self) -> int:
        return self._log.last()[0]

    def manifest(self, number: int | None = None) -> DataFrame:
        """(path, lo, hi, n): the data files of a version."""
        entries = self._log.entries()
        return self.spark.read.parquet(f"{self.root}/manifests/{entries[(number or len(entries)) - 1]}")

    def read(self, number: int | None = None) -> DataFrame:
        return self._read([r.path for r in self.manifest(number).select("path").collect()])

    def _read(self, paths: list[str]) -> DataFrame:
        """The rows of data files, without the folder column; the list of files is what Spark plans a scan with."""
        df = self.spark.read.schema(self._schema()).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())
        return df

    def _schema(self):
        name = self._log.entries()[0]
        return self.spark.read.parquet(f"{self.root}/schemas/{name}").schema

    # making -----------------------------------------------------------------
    def create(self, rows: DataFrame) -> None:
        """The first version, in files of about ``file_rows`` rows cut by key."""
        name = uuid.uuid4().hex[:12]
        rows.limit(0).write.parquet(f"{self.root}/schemas/{name}")
        files = self._write_cut(rows, name)
        files.write.parquet(f"{self.root}/manifests/{name}")
        if not self._log.claim(1, name):
            raise K.Conflict("the table is there already")

    def _write_cut(self, rows: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-rows.count() // self.file_rows))
        path = f"{self.root}/data/{name}"
        rows.repartitionByRange(n, self.key).sortWithinPartitions(self.key).write.parquet(path)
        return self._described(path)

    def _described(self, path: str) -> DataFrame:
        """Manifest rows of the files below ``path``."""
        return (self.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), self.key).groupBy("path")
                .agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi"), F.count(F.lit(1)).alias("n")))

    # changing ---------------------------------------------------------------
    def owners(self, keys: DataFrame, manifest: DataFrame) -> DataFrame:
        """(key, path) of the file that owns each of the distinct keys: the smallest keys of the files, filled down."""
        asked = keys.select(F.col(self.key).alias("k")).where("k is not null").distinct()
        first = manifest.agg(F.min_by("path", "lo").alias("first"))      # one row
        line = manifest.select(F.col("lo").alias("k"), F.lit(0).alias("kind"), "path").unionByName(
            asked.select("k", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("path")))
        filled = keyed_scan(line, None, ["k", "kind"], fills={"own": "path"}).where("kind = 1")
        return filled.crossJoin(F.broadcast(first)).select(F.col("k").alias(self.key), F.coalesce("own", "first").alias("path"))

    def _change(self, keys: DataFrame, kernel: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Rewrite the owners of ``keys``: ``kernel`` makes their new rows, with the columns ``_owner`` and ``_op``."""
        while True:
            entries = self._log.entries()
            manifest = self.manifest()
            name = uuid.uuid4().hex[:12]
            path = f"{self.root}/owners/{name}"
            self.owners(keys, manifest).write.parquet(path)
            owners = self.spark.read.parquet(path)
            touched = [r.path for r in owners.select("path").distinct().collect()]
            if not touched:
                return {f"n_{k}": 0 for k in (K.INSERTED, K.DELETED, K.UPDATED)}
            state = self._read(touched).withColumn(_OWNER, F.xxhash64("_metadata.file_path"))
            after = kernel(state, owners.select(self.key, F.xxhash64("path").alias(_OWNER)))
            data = f"{self.root}/data/{name}"
            counts = K.write_counted(after.repartition(len(touched), _OWNER).sortWithinPartitions(_OWNER, self.key), data, _OP, [_OWNER])
            if sum(counts.values()) == 0:
                return counts
            kept = manifest.join(owners.select("path").distinct(), "path", "left_anti")
            made = self._described(data) if self._stored(data) else manifest.limit(0)
            kept.unionByName(made).write.parquet(f"{self.root}/manifests/{name}")
            if self._log.claim(len(entries) + 1, name):
                return counts

    def _stored(self, path: str) -> bool:
        fs = self._log._fs
        return any(s.isDirectory() for s in fs.listStatus(self._log._path(path)))

    def upsert(self, rows: DataFrame, seq: str | None = None) -> dict[str, int]:
        """K3; returns the affected rows.  Rows without a key are left out."""
        rows = rows.where(F.col(self.key).isNotNull())
        return self._change(rows, lambda state, owners: K.upsert(state, rows.join(owners, self.key), self.key, seq, op=_OP))

    def update(self, changes: DataFrame, fields: Sequence[str], seq: str | None = None) -> dict[str, int]:
        """K4; returns the affected rows."""
        return self._change(changes, lambda state, owners: K.update(state, changes, self.key, fields, seq, op=_OP))

    def delete(self, keys: DataFrame) -> dict[str, int]:
        """K5; returns the affected rows."""
        return self._change(keys, lambda state, owners: K.delete(state, keys, self.key, op=_OP))

    def append(self, rows: DataFrame, order: Sequence[str]) -> int:
        """K1: rows with keys behind the largest one, in new files; no old file is read but for its manifest row."""
        while True:
            entries, manifest = self._log.entries(), self.manifest()
            name = uuid.uuid4().hex[:12]
            keyed = K.assign_keys(manifest.select(F.col("hi").alias(self.key)), rows, self.key, order)
            types = {f.name: f.dataType for f in self._schema().fields}
            made = self._write_cut(keyed.select(*[(F.col(c) if c in keyed.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]), name)
            manifest.unionByName(made).write.parquet(f"{self.root}/manifests/{name}")
            if self._log.claim(len(entries) + 1, name):
                return made.agg(F.sum("n")).first()[0] or 0
