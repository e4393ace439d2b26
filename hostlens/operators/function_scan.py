"""Keyed scans over functions: the state of a machine at every row, with a hot key in many tasks.

Each row is a function from state to state (an array: the state after the row for
every state before it).  A machine that reads one row after the other would put a
key into one task; functions, however, compose.  So, over the slices of
``scan.sliced``:

1. every slice composes its rows' functions, from all states at once; where a
   key starts inside the slice, the function from there on is constant;
2. the slices' functions, one row each, are applied in order, which gives the
   state that every slice is entered with;
3. that state goes to the slice's head as one more row, a constant function, and
   the slice is run through once more for the states before and after each row.

Inside a batch, compositions are made for all rows at once by doubling the
distance (log n array look-ups), not row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.operators.scan import _KEY, _PART, _ROLE, computed_once, slice_count, sliced

#: Rows whose functions are composed at a time.
CHUNK = 4096


def function_scan(df: DataFrame, key: Column | str | None, order: Sequence[Column | str], step: Column, *, states: int,
                  start: int = 0, before: str = "_before", after: str = "_after", partitions: int | None = None) -> DataFrame:
    """Add the state before and after each row.

    ``step`` is an array of ``states`` integers: the state after the row for each state before
    it.  Every key starts in ``start``; ``order`` must be a total order within the key.
    """
    key_col = F.lit(0) if key is None else (F.col(key) if isinstance(key, str) else key)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ords = [f"_sk{i}" for i in range(len(order_cols))]
    base = computed_once(df.withColumns({_KEY: key_col, "_step": step.cast("array<int>"), **dict(zip(ords, order_cols))}))
    n = partitions or slice_count(base)
    data = sliced(base, [_KEY, *ords], n)

    # 1. the function of each slice
    in_slice = Window.partitionBy(_PART).orderBy(_KEY, *ords)        # the order of the sort below: one sort serves both
    starts = F.coalesce(F.row_number().over(in_slice) > 1, F.lit(False)) & ~F.lag(F.struct(_KEY)).over(in_slice).eqNullSafe(F.struct(_KEY))
    narrow = (data.select(_PART, _KEY, *ords, "_step").repartitionById(n, _PART).withColumn("_starts", starts)
              .sortWithinPartitions(_PART, _KEY, *ords).select(_PART, "_starts", "_step"))
    composed = narrow.mapInArrow(_compose(states, start), f"{_PART} int, _map array<int>")
    # by slice number too: the least and the greatest of texts are found by sorting, here one slice at a time
    ends = data.select(_PART, _KEY).repartitionById(n, _PART).groupBy(_PART).agg(F.min(F.struct(_KEY)).alias("first_k"), F.max(F.struct(_KEY)).alias("last_k"))
    # 2. one row per slice from here on: whether it goes on with the key of the slice before, and its entry state
    by_part = Window.orderBy(_PART)
    linked = (composed.join(ends, _PART)
              .select(_PART, "first_k", F.coalesce(F.lag("last_k").over(by_part).eqNullSafe(F.col("first_k")), F.lit(False)).alias("_joins"), "_map"))
    heads = linked.coalesce(1).sortWithinPartitions(_PART).select(_PART, "_joins", "_map").mapInArrow(_entries(start), f"{_PART} int, _entry int")
    head = heads.select(_PART, F.lit(-1).alias(_ROLE), F.array_repeat("_entry", states).alias("_step"))
    # 3. the slices once more, from their entry states
    placed = (data.withColumn(_ROLE, F.lit(0)).unionByName(head, allowMissingColumns=True).repartitionById(n, _PART))
    in_order = Window.partitionBy(_PART).orderBy(_ROLE, _KEY, *ords)
    # a row that stands behind another key's row starts its key; the first row of a slice is told by the head
    starts = F.coalesce(F.lag(_ROLE).over(in_order) == 0, F.lit(False)) & ~F.lag(F.struct(_KEY)).over(in_order).eqNullSafe(F.struct(_KEY))
    ready = placed.withColumn("_starts", starts).sortWithinPartitions(_PART, _ROLE, _KEY, *ords)
    keep = [f.name for f in df.schema.fields]
    wanted = ready.select(_ROLE, "_starts", "_step", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    schema = T.StructType([T.StructField(_ROLE, T.IntegerType()), *[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(data.schema[c] for c in keep)],
                           T.StructField("_b", T.IntegerType()), T.StructField("_a", T.IntegerType())])
    run = wanted.mapInArrow(_replay(states, start), schema)
    return run.where(F.col(_ROLE) == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("_b").alias(before), F.col("_a").alias(after))


# The functions below run in the tasks.  They are closures that import what they need, so that
# executors need not have this package.

def _prefixes():
    import numpy as np

    def prefixes(maps, starts, start: int):
        """Composition of all functions up to each row, in place of ``maps`` (rows x states)."""
        out = maps.copy()
        out[starts] = maps[starts, start][:, None]
        step = 1
        while step < len(out):
            out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
            step *= 2
        return out

    return prefixes


def _compose(states: int, start: int):
    prefixes, chunk = _prefixes(), CHUNK

    def compose(batches):
        import numpy as np
        import pyarrow as pa
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int32()))], names=["_scan_part", "_map"])

        for b in batches:
            part, starts = np.asarray(b.column(0)), np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            maps = np.asarray(b.column(2).flatten()).reshape(-1, states)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and part[lo] != at:
                    if at is not None:
                        yield done()
                    at, total = int(part[lo]), np.arange(states)
                for i in range(lo, hi, chunk):
                    j = min(i + chunk, hi)
                    total = prefixes(maps[i:j], starts[i:j], start)[-1][total]
        if at is not None:
            yield done()

    return compose


def _entries(start: int):
    def entries(batches):
        import pyarrow as pa
        state = start
        for b in batches:
            parts, found = b.column(0).to_pylist(), []
            for joins, step in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found.append(state if joins else start)
                state = step[found[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(found, pa.int32())], names=["_scan_part", "_entry"])

    return entries


def _replay(states: int, start: int):
    prefixes, chunk = _prefixes(), CHUNK

    def replay(batches):
        import numpy as np
        import pyarrow as pa
        state = start
        for b in batches:
            starts = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            maps = np.asarray(b.column(2).flatten()).reshape(-1, states)
            before, after = np.empty(len(maps), np.int32), np.empty(len(maps), np.int32)
            for i in range(0, len(maps), chunk):
                j = min(i + chunk, len(maps))
                after[i:j] = prefixes(maps[i:j], starts[i:j], start)[:, state]
                before[i:j] = np.concatenate([[state], after[i:j - 1]])
                state = int(after[j - 1])
            before[starts] = start
            kept = [b.column(0), *b.columns[3:], pa.array(before), pa.array(after)]
            yield pa.RecordBatch.from_arrays(kept, names=[b.schema.names[0], *b.schema.names[3:], "_b", "_a"])

    return replay
