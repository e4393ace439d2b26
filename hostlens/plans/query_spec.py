"""A declarative select / join / where / group / order / limit spec,
applied with DataFrame calls (never by assembling SQL text from values).

Expressions inside a spec are SQL expression fragments over the aliases of
the tables (``selectExpr`` / ``expr``), as in the reference's dict form.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The comparators a join condition may use, and the join types.
JOIN_OPS = ("=", "<", "<=", ">", ">=", "<>")
JOIN_TYPES = ("inner", "left", "right", "full", "cross", "left_semi", "left_anti")
#: A table that is declared to be no larger may be broadcast.
BROADCAST_ROWS = 100_000
_PARAM = "_param_"
_NAMES = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|(?<![:\w]):([A-Za-z_]\w*)""")


@dataclass(frozen=True)
class JoinSpec:
    table: str
    alias: str
    left: str            # column of the tables joined so far, ``alias.col``
    op: str              # one of JOIN_OPS
    right: str           # column of this table (``col`` or ``alias.col``)
    how: str = "inner"
    max_rows: int | None = None    # declared bound of this table; theta and cross joins need one

    def condition(self) -> Column:
        if self.op not in JOIN_OPS:
            raise ValueError(f"join comparator {self.op!r} not allowed")
        r = self.right if "." in self.right else f"{self.alias}.{self.right}"
        lc, rc = F.col(self.left), F.col(r)
        return {"=": lc == rc, "<": lc < rc, "<=": lc <= rc, ">": lc > rc,
                ">=": lc >= rc, "<>": lc != rc}[self.op]


@dataclass(frozen=True)
class QuerySpec:
    table: str
    alias: str | None = None
    select: Sequence[str] | str = "*"
    joins: Sequence[JoinSpec] = ()
    where: str | None = None
    group_by: Sequence[str] = ()
    aggregates: Sequence[str] = ()
    having: str | None = None
    order_by: Sequence[tuple[str, str]] = ()
    limit: int | None = None
    offset: int | None = None
    params: Mapping[str, object] = field(default_factory=dict)     # values of ``:name`` in expressions

    def bound(self, text: str) -> str:
        """``text`` with every ``:name`` outside quotes as a reference to a column that holds its value."""
        def one(m: re.Match) -> str:
            if m[1]:
                return m[1]
            if m[2] not in self.params:
                raise ValueError(f"no value for parameter :{m[2]}")
            return f"`{_PARAM}{m[2]}`"

        return _NAMES.sub(one, text)

    def _with_params(self, df: DataFrame) -> DataFrame:
        """Parameters as literal columns: bound values, never text of the expression; the optimizer folds them."""
        return df.withColumns({_PARAM + k: F.lit(v) for k, v in self.params.items()}) if self.params else df

    def apply(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        df = tables[self.table].alias(self.alias or self.table)
        for j in self.joins:
            if j.how not in JOIN_TYPES:
                raise ValueError(f"join type {j.how!r} not allowed")
            if (j.how == "cross" or j.op != "=") and j.max_rows is None:
                raise ValueError(f"a {j.how} join by {j.op!r} compares all pairs: declare max_rows of {j.table}")
            other = tables[j.table].alias(j.alias)
            if j.max_rows is not None and j.max_rows <= BROADCAST_ROWS:
                other = F.broadcast(other)
            df = df.crossJoin(other) if j.how == "cross" else df.join(other, j.condition(), j.how)
        df = self._with_params(df)
        if self.where:
            df = df.where(F.expr(self.bound(self.where)))
        if self.group_by or self.aggregates:
            df = self._with_params(df.groupBy(*[F.expr(self.bound(g)) for g in self.group_by])
                                   .agg(*[F.expr(self.bound(a)) for a in self.aggregates]))
            if self.having:
                df = df.where(F.expr(self.bound(self.having)))
        sel = [self.select] if isinstance(self.select, str) else list(self.select)
        if sel != ["*"]:
            df = self._with_params(df.selectExpr(*[self.bound(x) for x in sel]))
        if self.order_by:
            df = df.orderBy(*[(F.expr(self.bound(c)).desc_nulls_last() if d.lower() == "desc" else F.expr(self.bound(c)).asc_nulls_first())
                              for c, d in self.order_by])
        df = df.drop(*[_PARAM + k for k in self.params])
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        return df


def raw_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: Mapping | None = None) -> DataFrame:
    """SQL pass-through with bound parameters (``:name``); ``{table}`` in the text stands
    for a frame of ``tables``, and no view of the session is touched."""
    return spark.sql(text, args=dict(args or {}), **tables)


def first_row(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row by a total order (top-1)."""
    return df.orderBy(*order).limit(1)


def column_values(df: DataFrame, col: str) -> DataFrame:
    """One column as a (distributed) list."""
    return df.select(col)
