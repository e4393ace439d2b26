"""K1-K5: write kernels as DataFrame plans.

Spark has no in-place update of parquet; each kernel returns the next version
of a table as a DataFrame.  ``publish`` writes it to a new versioned folder
under the shared scratch root and only then makes the numbered commit that
shows it, so a reader never sees a half-written table and nothing that is read
is ever overwritten; ``transact`` keeps concurrent writers from losing changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.identity import row_hash
from hostlens.operators.commits import CommitLog, Conflict
from hostlens.operators.scan import ordinal


def assign_keys(state: DataFrame, rows: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """K1 helper: give ``rows`` keys max(state.key) + 1 + position by ``order``;
    the first key of an empty table is 1.

    Positions come from a range-partitioned scan (no single-task window); the
    max is a one-row aggregate, so the cross join is with one row.
    """
    top = state.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("_max"))
    ranked = ordinal(rows, None, [F.col(o) if isinstance(o, str) else o for o in order], name="_pos")
    return (ranked.crossJoin(F.broadcast(top))
            .withColumn(key, F.col("_max") + 1 + F.col("_pos")).drop("_max", "_pos"))


def append_with_keys(state: DataFrame, rows: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """K1: append rows with assigned keys."""
    return state.unionByName(assign_keys(state, rows, key, order), allowMissingColumns=True)


def insert_ignore(state: DataFrame, rows: DataFrame, unique: str, seq: str | None = None) -> DataFrame:
    """K2: insert rows whose unique value is not yet stored.  Of duplicates the first by
    ``seq`` wins, else the smallest row, so the result is repeatable."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    new = (rows.groupBy(unique).agg(F.min_by(row, F.struct(seq, row) if seq else row).alias("_r")).select("_r.*")
           .join(state.select(unique), unique, "left_anti"))
    return state.unionByName(new, allowMissingColumns=True)


def _last_set(rows: DataFrame, key: str, fields: Sequence[str], seq: str | None, is_set) -> list[Column]:
    """Per field the value of the last row by ``seq`` that sets it (without ``seq`` the largest value)."""
    order = F.col(seq) if seq else None
    return [F.max_by(F.col(f), F.when(is_set(f), order if order is not None else F.struct(F.col(f).isNull(), F.col(f)))).alias("_n_" + f)
            for f in fields]


def upsert(state: DataFrame, rows: DataFrame, key: str, seq: str | None = None, op: str | None = None) -> DataFrame:
    """K3: insert new keys, refresh the fields of existing ones (new non-null values win).

    Rows that share a key are first reduced to one, applied in the order of ``seq``.  ``op`` names
    a column that says what became of a row: inserted, updated or kept.
    """
    cols = [c for c in state.columns if c != key]
    given = [c for c in cols if c in rows.columns]
    s = state.select(key, *[F.col(c).alias("_o_" + c) for c in cols], F.lit(True).alias("_stored"))
    r = rows.groupBy(key).agg(*_last_set(rows, key, given, seq, lambda f: F.col(f).isNotNull()), F.lit(True).alias("_given"))
    j = s.join(r, key, "full")
    changed = _any(F.col("_n_" + c).isNotNull() & ~F.col("_n_" + c).eqNullSafe(F.col("_o_" + c)) for c in given)
    kind = F.when(F.col("_stored").isNull(), INSERTED).when(changed, UPDATED).otherwise(KEPT)
    return j.select(key, *[F.coalesce(F.col("_n_" + c), F.col("_o_" + c)).alias(c) if c in given else F.col("_o_" + c).alias(c) for c in cols],
                    *([kind.alias(op)] if op else []))


#: What a kernel did with a row.
INSERTED, UPDATED, DELETED, KEPT = "inserted", "updated", "deleted", "kept"


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def update(state: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], seq: str | None = None, op: str | None = None) -> DataFrame:
    """K4: set fields of existing keys.

    ``changes`` holds ``key``, a value column per field and ``_set_<field>``
    flags; a set flag with a null value writes NULL (the null marker), an unset
    flag keeps the stored value.  Changes that share a key are first reduced to
    one, applied in the order of ``seq``.  A value that the column's stored type cannot
    hold leaves the stored value as it is (``unfit`` lists these).
    """
    ch = changes.groupBy(key).agg(*_last_set(changes, key, fields, seq, lambda f: F.coalesce(F.col("_set_" + f), F.lit(False))),
                                  *[F.bool_or(F.coalesce(F.col("_set_" + f), F.lit(False))).alias("_s_" + f) for f in fields])
    j = state.join(ch, key, "left")
    types = {**dict(state.dtypes), "_from": dict(changes.dtypes)}

    def written(c: str) -> Column:
        new = _stored_as(F.col("_n_" + c), types["_from"].get(c), types[c])
        kept = ~F.coalesce(F.col("_s_" + c), F.lit(False)) | (F.col("_n_" + c).isNotNull() & new.isNull())
        return F.when(kept, F.col(c)).otherwise(new).alias(c)

    changed = _any(~written(c).eqNullSafe(F.col(c)) for c in fields)
    return j.select(*[written(c) if c in fields else F.col(c) for c in state.columns], *([F.when(changed, UPDATED).otherwise(KEPT).alias(op)] if op else []))


def _stored_as(value: Column, given: str | None, kind: str) -> Column:
    """``value`` in the column's stored type; null where it does not fit."""
    return value if given == kind else value.try_cast(kind)


def unfit(state: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, value) of changes that the stored type cannot hold; ``update`` leaves these fields as they are."""
    types, given = dict(state.dtypes), dict(changes.dtypes)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"),
                              (F.col("_set_" + f) & F.col(f).isNotNull() & _stored_as(F.col(f), given[f], types[f]).isNull()).alias("bad")) for f in fields])
    return changes.select(key, F.explode(each).alias("_e")).where("_e.bad").select(key, "_e.field", "_e.value")


def delete(state: DataFrame, keys: DataFrame, key: str, op: str | None = None) -> DataFrame:
    """K5: remove rows by key (anti join).  With ``op`` the rows that go are still there, marked, for ``write_counted``."""
    gone = keys.select(key).distinct()
    if not op:
        return state.join(gone, key, "left_anti")
    return state.join(gone.withColumn("_gone", F.lit(True)), key, "left").select(*state.columns, F.when(F.col("_gone"), DELETED).otherwise(KEPT).alias(op))


def write_counted(df: DataFrame, path: str, op: str, partition_by: Sequence[str] = ()) -> dict[str, int]:
    """R14 while writing: write the rows that stay and return how many were inserted, deleted and updated.
    The counts are observed on the rows as they are written: no second look at either version."""
    seen = Observation()
    counted = df.observe(seen, *[F.count_if(F.col(op) == kind).alias(f"n_{kind}") for kind in (INSERTED, DELETED, UPDATED)])
    rows = counted.where(F.col(op) != DELETED).drop(op)
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).mode("errorifexists").parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def affected(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Inserted / deleted / changed row counts between two versions, in one join.  A null key
    is a key like any other, and a value that moves from one column to another is a change."""
    cols = [c for c in before.columns if c != key]
    b = before.select(F.col(key).alias("_kb"), row_hash(before, cols).alias("_hb"))
    a = after.select(F.col(key).alias("_ka"), row_hash(after.select(key, *cols), cols).alias("_ha"))
    j = b.join(a, F.col("_kb").eqNullSafe(F.col("_ka")), "full")
    return j.agg(F.count_if(F.col("_hb").isNull()).alias("n_inserted"),
                 F.count_if(F.col("_ha").isNull()).alias("n_deleted"),
                 F.count_if(F.col("_hb").isNotNull() & F.col("_ha").isNotNull() &
                            (F.col("_hb") != F.col("_ha"))).alias("n_updated"))


def _log(spark: SparkSession, root: str, name: str) -> CommitLog:
    return CommitLog(spark, f"{root}/{name}/_published")


def publish(spark: SparkSession, df: DataFrame, root: str, name: str, after: int | None = None) -> str:
    """Write ``df`` as a new version of table ``name`` and show it; returns the version's path.

    A version is shown by a numbered commit that is made whole or not at all and never
    changed, so there is a complete version at every moment.  ``after`` is the number of
    the version that ``df`` was made from (``current_number``): if another writer has published
    since, nothing is shown and ``Conflict`` is raised.  Without it the version takes the
    next free number, whatever is there.
    """
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(f"{root}/{name}/{version}")
    log = _log(spark, root, name)
    if after is not None:
        if not log.claim(after + 1, version):
            raise Conflict(f"version {after + 1} of {name} was published by another writer")
    else:
        while not log.claim(log.last()[0] + 1, version):
            pass
    return f"{root}/{name}/{version}"


def current_number(spark: SparkSession, root: str, name: str) -> int:
    """The number of the newest published version of table ``name``; 0 if there is none."""
    return _log(spark, root, name).last()[0]


def current(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """The newest published version of table ``name``, or the one of that number."""
    log = _log(spark, root, name)
    version = log.last()[1] if number is None else log.entries()[number - 1]
    return spark.read.parquet(f"{root}/{name}/{version}")


def transact(spark: SparkSession, root: str, name: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> str:
    """Publish ``change`` of the newest version; if another writer was first, it is made again from that
    writer's version, so that no change is lost."""
    for _ in range(tries):
        number = current_number(spark, root, name)
        try:
            return publish(spark, change(current(spark, root, name, number)), root, name, after=number)
        except Conflict:
            continue
    raise Conflict(f"{name} was changed by other writers {tries} times")


#: Key sets up to this size may be broadcast; larger ones are joined as tables.
BROADCAST_KEYS = 100_000


def _few(keys: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(keys) if limit <= BROADCAST_KEYS else keys


def top_k_keys(state: DataFrame, key: str, where: str | None, order: Sequence[Column], limit: int) -> DataFrame:
    """The keys an ``... WHERE .. ORDER BY .. LIMIT n`` statement touches (top-k, not a full sort)."""
    df = state.where(where) if where else state
    return df.orderBy(*order, F.col(key)).limit(limit).select(key)


def update_top_k(state: DataFrame, key: str, where: str | None, order: Sequence[Column], limit: int,
                 set_exprs: dict[str, Column]) -> DataFrame:
    """Update set .. where .. order by .. limit n."""
    keys = top_k_keys(state, key, where, order, limit).withColumn("_hit", F.lit(True))
    j = state.join(_few(keys, limit), key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = j
    for c, e in set_exprs.items():
        out = out.withColumn(c, F.when(hit, e).otherwise(F.col(c)))
    return out.drop("_hit")


def delete_top_k(state: DataFrame, key: str, where: str | None, order: Sequence[Column], limit: int) -> DataFrame:
    """Delete where .. order by .. limit n."""
    return state.join(_few(top_k_keys(state, key, where, order, limit), limit), key, "left_anti")
