"""An inner join of the two sides of a stream whose waiting rows are in files (I1 on a stream).

A row of either side may come before its partners, so both sides are kept for ``delay``.  Spark's
stream join keeps them in its state store, which by default is the executors' memory; here each batch writes its rows to
folders below ``root``, and old rows are met with new ones by a batch join, which spills.  A batch costs its own rows, and
one pass over the waiting left rows if it brings right ones.

As in Spark's join the watermark is the least of both sides' latest times less ``delay``, after the batches before; rows
not after it are late and are left out, and folders in which nothing can meet a later row are deleted.

A batch becomes visible through one numbered commit, which also names what the next one needs to know; a batch that is run
again after a failure is already committed and changes nothing.  Its result is a folder below ``met``, put there whole.
"""

from __future__ import annotations

import uuid
from dataclasses import astuple, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.operators.commits import CommitLog
from hostlens.operators.scan import SLICE_ROWS

#: Right rows up to this number (counted) go to the left ones as a broadcast; more of them are shuffled with them.
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class Batch:
    """What a commit's name holds; times are microseconds, 0 if there is none."""

    batch: int
    id: str
    first: int              # the first commit whose rows may still meet others
    left_top: int           # latest times so far
    right_top: int
    left_max: int = 0       # of this batch's rows alone
    right_max: int = 0
    left_rows: int = 0
    right_rows: int = 0

    @property
    def name(self) -> str:
        return "@".join(map(str, astuple(self)))

    @property
    def folder(self) -> str:
        return f"{self.batch}-{self.id}"


def _batch(name: str) -> Batch:
    batch, made, *numbers = name.split("@")
    return Batch(int(batch), made, *map(int, numbers))


class WaitingJoin:
    """Pairs of rows with the same ``key`` whose times (``left_time``, ``right_time``) are at most ``delay`` apart.  The
    left rows of one key are spread over ``salts`` keys by ``spread``."""

    def __init__(self, spark: SparkSession, root: str, left: T.StructType, right: T.StructType, *, key: str,
                 left_time: str, right_time: str, delay: str, spread: str, salts: int = 8):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), {"left": left, "right": right}
        self.key, self.times, self.delay, self.spread, self.salts = key, {"left": left_time, "right": right_time}, delay, spread, salts
        self.schema = T.StructType([*left.fields, *[f for f in right.fields if f.name != key]])
        self.met = f"{self.root}/met"
        self._log = CommitLog(spark, f"{self.root}/commits")
        self._path, self._fs = self._log._path, self._log._fs
        self._fs.mkdirs(self._path(self.met))
        self._wait = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {delay}"))).first()[0]
        if self._wait < 0:
            raise ValueError("a delay is not negative")

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def watermark(self, b: Batch) -> int:
        """After a batch; whole milliseconds, as Spark's."""
        return max(0, min(b.left_top, b.right_top) // 1000 * 1000 - self._wait)

    def publish(self) -> None:
        """Put the result of the last commit in its place, if its writer stopped before it did."""
        last = self._log.last()[1]
        made = last and f"{self.root}/making/{_batch(last).folder}"
        if made and self.exists(made) and not self._fs.rename(self._path(made), self._path(f"{self.met}/{_batch(last).folder}")):
            raise RuntimeError(f"cannot put {made} in its place")

    def append(self, batch: int, left: DataFrame, right: DataFrame) -> bool:
        """Meet a batch's rows with each other and with those that wait, once; False if it was committed before."""
        self.publish()
        number, name = self._log.last()
        last = _batch(name) if number else Batch(-1, "", 1, 0, 0)
        if last.batch >= batch:
            return False
        waiting = [_batch(self._log._name(i)) for i in range(last.first, number + 1)]
        mark, made = self.watermark(last), Batch(batch, uuid.uuid4().hex[:12], 0, 0, 0)
        (left_max, left_rows), (right_max, right_rows) = (self._keep(side, df, mark, made.folder) for side, df in (("left", left), ("right", right)))
        now = replace(made, left_top=max(last.left_top, left_max), right_top=max(last.right_top, right_max),
                      left_max=left_max, right_max=right_max, left_rows=left_rows, right_rows=right_rows)
        lefts = [b for b in waiting if b.left_max + self._wait > mark]
        rights = [b for b in waiting if b.right_max + self._wait > mark]
        met = [m for m in (self._pairs([*lefts, now], [now]), self._pairs([now], rights)) if m is not None]
        out = reduce(DataFrame.unionByName, met) if met else self.spark.createDataFrame([], self.schema)
        out.write.parquet(f"{self.root}/making/{made.folder}")
        # commits whose rows can meet no later one, from the first on, as the next batch reads a range
        known, mark = [*waiting, now], self.watermark(now)
        gone = next((i for i, b in enumerate(known) if max(b.left_max, b.right_max) + self._wait > mark), len(known))
        if not self._log.claim(number + 1, replace(now, first=last.first + gone).name):
            return False
        self.publish()
        for b in known[:gone]:
            for side in self.schemas:
                self._fs.delete(self._path(f"{self.root}/{side}/{b.folder}"), True)
        return True

    def _keep(self, side: str, df: DataFrame, mark: int, folder: str) -> tuple[int, int]:
        """Write a batch's rows that are not late and have a key; their latest time and their number."""
        at = F.col(self.times[side])
        df.where(F.col(self.key).isNotNull() & (at > F.timestamp_micros(F.lit(mark)))).select(*self.schemas[side].names).write.parquet(f"{self.root}/{side}/{folder}")
        top, rows = self._read(side, [folder]).agg(F.max(F.unix_micros(at)), F.count(F.lit(1))).first()
        return top or 0, rows

    def _read(self, side: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schemas[side]).parquet(*[f"{self.root}/{side}/{f}" for f in folders])

    def _pairs(self, lefts: list[Batch], rights: list[Batch]) -> DataFrame | None:
        lefts, rights = [b for b in lefts if b.left_rows], [b for b in rights if b.right_rows]
        if not lefts or not rights:
            return None
        left, right = self._read("left", [b.folder for b in lefts]), self._read("right", [b.folder for b in rights]).withColumnRenamed(self.key, "_key")
        at, other, wait = F.col(self.times["left"]), F.col(self.times["right"]), F.expr(f"INTERVAL {self.delay}")
        meets = (F.col(self.key) == F.col("_key")) & (at >= other - wait) & (at <= other + wait)
        n_left, n_right = sum(b.left_rows for b in lefts), sum(b.right_rows for b in rights)
        if n_right <= BROADCAST_ROWS:
            return left.join(F.broadcast(right), meets).select(*self.schema.names)
        rows = int(self.spark.conf.get("hostlens.scan.sliceRows", str(SLICE_ROWS)))
        n = max(self.spark.sparkContext.defaultParallelism, -(-(n_left + self.salts * n_right) // max(1, rows)))
        left = left.withColumn("_salt", F.pmod(F.hash(self.spread), F.lit(self.salts))).repartition(n, self.key, "_salt")
        right = right.withColumn("_rsalt", F.explode(F.array(*[F.lit(i) for i in range(self.salts)]))).repartition(n, "_key", "_rsalt")
        return left.join(right.hint("shuffle_hash"), meets & (F.col("_salt") == F.col("_rsalt"))).select(*self.schema.names)
