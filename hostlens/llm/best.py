"""Mergeable k-best lists: each task keeps the k best entries per slot, and the lists of all tasks merge.

An entry is a struct that is ordered by its fields, larger is better.  A task
emits one row per slot: its entries, and the k-th of them as ``least`` if it
holds k.  The largest ``least`` of a slot is a floor, as k entries reach it, so
only entries at or over the floor are exploded and ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import group_starts


def schema(fields: list[str]) -> str:
    entry = "struct<" + ", ".join(f"{f}: long" for f in fields) + ">"
    return f"slot int, least {entry}, entries array<{entry}>"


def task_rows(slot: np.ndarray, fields: dict[str, np.ndarray], k: int) -> pa.RecordBatch:
    """One row per slot; entries are sorted by slot, the best first, k per slot at most."""
    starts = group_starts([slot]) if len(slot) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(slot)) if len(slot) else starts
    columns = [pa.array(v, pa.int64()) for v in fields.values()]
    entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(slot)), pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))
    least = pa.StructArray.from_arrays([c.take(pa.array(ends - 1)) for c in columns], list(fields), mask=pa.array(ends - starts < k, pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(slot[starts], pa.int32()), least, entries], names=["slot", "least", "entries"])


def merged(found: DataFrame, k: int) -> DataFrame:
    """(slot, rank, the fields of an entry) of the ``k`` best entries per slot; ``found`` is a written
    table of ``task_rows``, whose slots are of bounded number."""
    floors = found.where("least is not null").groupBy("slot").agg(F.max("least").alias("floor"))
    over = F.filter("entries", lambda e: F.col("floor").isNull() | (e >= F.col("floor")))
    entries = found.join(F.broadcast(floors), "slot", "left").select("slot", F.explode(over).alias("e"))
    order = Window.partitionBy("slot").orderBy(F.desc("e"))
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("slot", "rank", "e.*")
