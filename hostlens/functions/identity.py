"""Row identity: hashes in which a null is not the same as a missing column.

Spark's hash functions pass over nulls, so ``('a', null)`` and ``(null, 'a')``
hash alike.  Here every column goes in as a pair, whether it is null and its
value, and columns whose insides may hold nulls, or that cannot be hashed (maps,
variants), go in as JSON text with nulls written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_safe(df: DataFrame, names: Sequence[str] | None = None) -> list[Column]:
    """Expressions over the columns ``names`` (default: all) of ``df``, in order, whose
    hash tells rows apart."""
    out = []
    for f in df.schema.fields:
        if names is not None and f.name not in names:
            continue
        c = F.col(f"`{f.name}`")
        value = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if _nested(f.dataType) else c
        out += [c.isNull(), value] if not isinstance(f.dataType, T.NullType) else []
    return out or [F.lit(0)]


def row_hash(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """64-bit hash of the columns ``names`` of a row."""
    return F.xxhash64(*null_safe(df, names))


def row_key(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """128-bit hash, as text, of the columns ``names`` of a row."""
    cols = null_safe(df, names)
    return F.concat(F.hex(F.xxhash64(*cols)), F.lit(" "), F.hex(F.xxhash64(F.lit("second"), *cols)))


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
