"""Running positions and fill-downs of a table that grows (S1 with I2, Q8, Q12).

Appended rows are numbered on their own; what earlier batches carry into them is
kept per key: the number of rows so far and the last values.  A batch writes its
rows and the new carry of the keys it touches, and becomes visible through one
numbered commit; a batch that was committed before is left alone, so a replayed or
restarted batch changes nothing.  Every ``fold``-th commit writes the carry of all
keys, and readers start from the last such one; so a batch costs what it holds, and
now and then one pass over the keys.

Batches follow each other: all rows of a batch stand behind those of earlier
batches of the same key.  Concurrent writers take turns (``CommitLog``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.operators.commits import CommitLog
from hostlens.operators.scan import keyed_scan, ordinal


class RunningTable:
    """Rows with their 0-based position ``name`` within ``key`` by ``order``, and the columns ``fills`` filled down."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, order: Sequence[str], *,
                 name: str = "rn", fills: Sequence[str] = (), fold: int = 32):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.order, self.name, self.fills, self.fold = key, list(order), name, list(fills), fold
        self._log = CommitLog(spark, f"{self.root}/commits")
        self._made = T.StructType([*schema.fields, T.StructField(name, T.LongType())])
        last = [T.StructField("last_" + f, schema[f].dataType) for f in self.fills]
        self._carry_schema = T.StructType([schema[key], T.StructField("n", T.LongType()), *last])

    def committed(self) -> list[str]:
        """Batch ids in the order of their commits."""
        return [e.split("@")[0] for e in self._log.entries()]

    def _read(self, what: str, entries: list[str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.root}/{what}/{e}" for e in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, entries: list[str] | None = None) -> DataFrame:
        return self._read("rows", self._log.entries() if entries is None else entries, self._made)

    def carry(self, entries: list[str] | None = None) -> DataFrame:
        """(key, n, last values) at present: the youngest row of each key since the last whole carry."""
        entries = self._log.entries() if entries is None else entries
        whole = max((i for i, e in enumerate(entries) if e.endswith("@all")), default=0)
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/carry/([^/]+)/", 1)
        read = self._read("carry", entries[whole:], self._carry_schema)
        if not entries:
            return read
        turn = F.array_position(F.array(*[F.lit(e) for e in entries[whole:]]), at)
        row = F.struct(*[F.col(f.name) for f in self._carry_schema.fields])
        return read.select(row.alias("r"), turn.alias("turn")).groupBy(F.col(f"r.{self.key}")).agg(F.max_by("r", "turn").alias("r")).select("r.*")

    def append(self, batch_id: str, rows: DataFrame) -> bool:
        """Number and keep the rows of a batch once; False if it was committed before."""
        if not batch_id or set(batch_id) & set("@/"):
            raise ValueError("a batch id has no @ or /")
        while True:
            entries = self._log.entries()
            if batch_id in [e.split("@")[0] for e in entries]:
                return False
            whole = (len(entries) + 1) % self.fold == 0
            entry = f"{batch_id}@{uuid.uuid4().hex[:12]}" + ("@all" if whole else "")
            self._write(entry, rows.select(*[f.name for f in self.schema.fields]), entries, whole)
            if self._log.claim(len(entries) + 1, entry):
                return True

    def _write(self, entry: str, rows: DataFrame, entries: list[str], whole: bool) -> None:
        key = self.key
        made = ordinal(rows, key, self.order, name=self.name)
        if self.fills:
            made = keyed_scan(made, key, self.order, fills={"_f_" + f: f for f in self.fills})
        touched = rows.select(key).distinct()
        before = self.carry(entries).withColumnRenamed(key, "_k")
        known = before.join(touched, F.col("_k").eqNullSafe(F.col(key)), "left_semi")
        made = made.join(known, F.col(key).eqNullSafe(F.col("_k")), "left")
        made = made.withColumn(self.name, F.col(self.name) + F.coalesce("n", F.lit(0)))
        for f in self.fills:
            made = made.withColumn(f, F.coalesce("_f_" + f, "last_" + f))
        made.select(*[f.name for f in self._made.fields]).write.parquet(f"{self.root}/rows/{entry}")
        # the rows as written tell the new carry
        back = self.spark.read.schema(self._made).parquet(f"{self.root}/rows/{entry}")
        new = back.groupBy(key).agg((F.max(self.name) + 1).alias("n"), *[F.max_by(f, self.name).alias("last_" + f) for f in self.fills])
        if whole:
            new = new.unionByName(before.withColumnRenamed("_k", key).join(new.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti"))
        new.write.parquet(f"{self.root}/carry/{entry}")


def stream_positions(table: RunningTable, source: DataFrame, checkpoint_dir: str, name: str = "batch") -> None:
    """Number the rows of a streaming frame as they come, for everything available now; a micro-batch that is run
    again after a failure is already committed and changes nothing."""
    q = (source.writeStream.foreachBatch(lambda df, i: table.append(f"{name}-{i}", df) and None)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
