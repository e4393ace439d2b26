"""Lookup-joined fetch driven by a field spec.

A ``FetchSpec`` names the main table, its key, its fields and its lookups.
A lookup is either *single* (``main.fk = lookup.key``) or *list* (the main
column holds a comma list of keys).  ``fetch`` returns one row per main row:
``DT_RowId`` (text key), ``main`` struct, one struct per single lookup and one
``array<struct<value,label>>`` per list lookup.

List lookups are rewritten from a set-membership theta join into a side branch
of (key, member) rows: explode, equi join for the labels, regroup by key, and
one join back, so main columns are never exploded or grouped and null or empty
lists never leave the main row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    table: str
    fk: str                                  # column of the main table, or ``lookup.column`` of an earlier single lookup
    fields: Sequence[str] = ()               # fields returned in the lookup struct
    label: Sequence[str] = ()                # label fields (list lookups, options)
    key: str = "pkid"
    how: str = "left"                        # inner or left
    kind: str = "single"                     # single or list
    separator: str = " "
    scope_col: str | None = None             # lookup column holding the scope


@dataclass(frozen=True)
class FetchSpec:
    main: str
    key: str
    fields: Sequence[str]
    lookups: Sequence[Lookup] = ()
    order: Sequence[tuple[str, str]] = ()
    limit: int | None = None
    scope_col: str | None = None             # main column holding the scope


def parse_key_filter(keys) -> list[int]:
    """Int, list of ints, or comma text of ints; anything else is an error."""
    if keys is None:
        return []
    if isinstance(keys, bool):
        raise ValueError("key filter must be numeric")
    if isinstance(keys, int):
        return [keys]
    if isinstance(keys, str):
        parts = [p.strip() for p in keys.split(",") if p.strip()]
    else:
        parts = list(keys)
    out = []
    for p in parts:
        s = str(p).strip()
        if not s.lstrip("-").isdigit():
            raise ValueError(f"key filter member {p!r} is not numeric")
        out.append(int(s))
    return out


def key_filter(df: DataFrame, col: str, keys) -> DataFrame:
    """Filter by a key list (validated at plan time) or by a key table (semi join)."""
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(col)).distinct()
        return df.join(k, col, "left_semi")
    ks = parse_key_filter(keys)
    return df.where(F.col(col).isin(ks)) if ks else df


def scope_filter(df: DataFrame, col: str | None, active) -> DataFrame:
    """Keep the active scope when the table has the scope column."""
    if col is None or active is None or col not in df.columns:
        return df
    return df.where(F.col(col) == F.lit(active))


def list_ids(col) -> Column:
    """Comma list text -> array<bigint>; null or blank -> empty array; non-numeric members dropped."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p) != "")
    return F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("bigint")), lambda v: v.isNotNull())


def list_bad_members(col) -> Column:
    """The members of a comma list that are not integers (error column)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p) != "")
    return F.filter(parts, lambda p: F.trim(p).try_cast("bigint").isNull())


def json_ids(col) -> Column:
    """JSON ``[{"id": ..}, ..]`` -> array<struct<id:bigint>>; bad or null -> empty."""
    c = F.col(col) if isinstance(col, str) else col
    parsed = F.from_json(c, "array<struct<id:string>>")
    ids = F.transform(parsed, lambda e: F.struct(e["id"].try_cast("bigint").alias("id")))
    return F.coalesce(ids, F.array().cast("array<struct<id:bigint>>"))


def label_expr(fields: Sequence[str], separator: str = " ", prefix: str = "") -> Column:
    cols = [F.col(prefix + f).cast("string") for f in fields]
    return cols[0] if len(cols) == 1 else F.concat_ws(separator, *cols)


def nest_dotted(df: DataFrame) -> DataFrame:
    """Result columns named ``a.b`` become fields of a struct ``a``."""
    groups: dict[str, list[str]] = {}
    plain = []
    for c in df.columns:
        if "." in c:
            groups.setdefault(c.split(".", 1)[0], []).append(c)
        else:
            plain.append(c)
    cols = [F.col(f"`{c}`") for c in plain]
    for g, names in groups.items():
        cols.append(F.struct(*[F.col(f"`{n}`").alias(n.split(".", 1)[1]) for n in names]).alias(g))
    return df.select(*cols)


def list_lookup_pairs(main: DataFrame, key: str, lk: Lookup, lookup_df: DataFrame) -> DataFrame:
    """T6 + T7: (main key, array<struct<value,label>>) sorted by label then value, distinct.

    Groups are one main row's list, so they stay as small as the lists are.
    """
    ex = main.select(F.col(key).alias("_k"), F.explode(F.array_distinct(list_ids(lk.fk))).alias("_v"))
    lab = lookup_df.select(F.col(lk.key).alias("_v"), label_expr(lk.label or lk.fields, lk.separator).alias("_l"))
    j = ex.join(lab, "_v").where(F.col("_l").isNotNull())
    pairs = F.array_sort(F.collect_set(F.struct(F.col("_l").alias("label"), F.col("_v").alias("value"))))
    return (j.groupBy("_k").agg(pairs.alias("_p"))
            .select("_k", F.transform("_p", lambda e: F.struct(e["value"].alias("value"),
                                                               e["label"].alias("label"))).alias("_pairs")))


def fetch(spec: FetchSpec, tables: Mapping[str, DataFrame], keys=None, scope=None) -> DataFrame:
    main = tables[spec.main]
    main = key_filter(main, spec.key, keys) if keys is not None else main
    main = scope_filter(main, spec.scope_col, scope)
    fields = [spec.key] + [f for f in spec.fields if f != spec.key]           # T4
    needed = list(dict.fromkeys([*fields, *[lk.fk for lk in spec.lookups if "." not in lk.fk]]))   # ordered, unique
    chained = {lk.table: [x.fk.split(".", 1)[1] for x in spec.lookups if x.fk.startswith(lk.table + ".")] for lk in spec.lookups}
    place = {lk.table: i for i, lk in enumerate(spec.lookups)}
    out = main.select(*needed)
    struct_cols = [F.col(spec.key).cast("string").alias("DT_RowId"),
                   F.struct(*[F.col(f) for f in fields]).alias("main")]
    for i, lk in enumerate(spec.lookups):
        ldf = scope_filter(tables[lk.table], lk.scope_col, scope)
        if lk.kind == "single":                                               # T5
            pre = f"_l{i}_"
            sel = ldf.select(*[F.col(c).alias(pre + c) for c in dict.fromkeys([lk.key, *lk.fields, *chained[lk.table]])])
            source, _, column = lk.fk.rpartition(".")
            fk = F.col(f"_l{place[source]}_{column}" if source else lk.fk)
            out = out.join(sel, fk == F.col(pre + lk.key), "inner" if lk.how == "inner" else "left")
            struct_cols.append(F.struct(*[F.col(pre + f).alias(f) for f in lk.fields]).alias(lk.table))
        else:                                                                 # T6-T8
            pairs = list_lookup_pairs(out, spec.key, lk, ldf).withColumnsRenamed({"_k": f"_k{i}", "_pairs": f"_pairs{i}"})
            out = out.join(pairs, F.col(spec.key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
            struct_cols.append(F.coalesce(F.col(f"_pairs{i}"), F.array().cast(
                "array<struct<value:bigint,label:string>>")).alias(lk.table))
    res = out.select(*struct_cols, F.col(spec.key).alias("_order_key"), *[F.col(f).alias("_o_" + f) for f in fields])
    if spec.order:                                                            # T9
        res = res.orderBy(*[F.col("_o_" + c).desc() if d.lower() == "desc" else F.col("_o_" + c).asc()
                            for c, d in spec.order] + [F.col("_order_key")])
    if spec.limit is not None:                                                # T10
        res = res.limit(spec.limit)
    return res.select("DT_RowId", "main", *[lk.table for lk in spec.lookups])   # T11


def options(lookups: Sequence[tuple[str, DataFrame, Sequence[str], str]], separator: str = " ",
            scope_col: str | None = None, scope=None) -> DataFrame:
    """Distinct (label, value) per lookup, all lookups in one frame.

    ``lookups``: (field name, lookup table, label fields, key column).
    The caller orders by (field, label, value) where order matters.
    """
    parts = []
    for field, df, label_fields, key in lookups:
        df = scope_filter(df, scope_col, scope)
        parts.append(df.select(F.lit(field).alias("field"),
                               label_expr(label_fields, separator).alias("label"),
                               F.col(key).cast("bigint").alias("value")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# T17-T20 -------------------------------------------------------------------
# Object types whose hosts are offered by role or by side, the role that is single, the text source's field.
ROLE_OBJECT, SIDE_OBJECT, SINGLE_ROLE, TEXT_SOURCE = "Cucm", "Ucce", "Pub", "fk_textfsm"


def _hosts_of(hosts: DataFrame, types: DataFrame, object_type: str) -> DataFrame:
    t = types.where(F.col("object_type") == object_type).select(F.col("pkid").alias("_type_key"), F.col("type").alias("_type"))
    return hosts.join(t, F.col("fk_types") == F.col("_type_key")).select("pkid", "hostname", "_type")


def role_options(hosts: DataFrame, types: DataFrame, object_type: str = ROLE_OBJECT) -> DataFrame:
    """(role, multi, value, label): hosts of a kind by the last word of their type; the
    publisher role takes one choice, the others many."""
    role = F.element_at(F.split("_type", " "), -1)
    return _hosts_of(hosts, types, object_type).select(role.alias("role"), (role != SINGLE_ROLE).alias("multi"),
                                                       F.col("pkid").alias("value"), F.col("hostname").alias("label"))


def side_options(hosts: DataFrame, types: DataFrame, object_type: str = SIDE_OBJECT) -> DataFrame:
    """(side, value, label): hosts whose name ends in a or b belong to that side, others to both."""
    last = F.lower(F.substring("hostname", -1, 1))
    sides = F.when(last.isin("a", "b"), F.array(last)).otherwise(F.array(F.lit("a"), F.lit("b")))
    return _hosts_of(hosts, types, object_type).select(F.explode(sides).alias("side"), F.col("pkid").alias("value"), F.col("hostname").alias("label"))


def catalogue(charts: DataFrame, uploads: DataFrame, sources: DataFrame, templates: DataFrame, counters: DataFrame) -> DataFrame:
    """(chart_id, upload_id, upload_name, source_field, filter_data) for all charts at once.

    A chart's JSON file set is exploded and joined to the uploads; its source says whether the
    template's text or the counter's name is what extracts the data.  ``sources`` is the seeded
    list of sources; the other joins are left to the planner.
    """
    files = charts.select(F.col("pkid").alias("chart_id"), "fk_graph_sources", "fk_textfsm", "fk_perfmon_counters",
                          F.explode(F.transform(json_ids("uploaded_files"), lambda x: x["id"])).alias("_file"))
    s = sources.select(F.col("pkid").alias("_source"), F.col("field").alias("source_field"))
    t = templates.select(F.col("pkid").alias("_template"), "script")
    c = counters.select(F.col("pkid").alias("_counter"), F.col("name").alias("_counter_name"))
    u = uploads.select(F.col("id").alias("upload_id"), F.col("filename").alias("upload_name"))
    return (files.join(u, F.col("_file") == F.col("upload_id")).join(s, F.col("fk_graph_sources") == F.col("_source"))
            .join(t, F.col("fk_textfsm") == F.col("_template"), "left").join(c, F.col("fk_perfmon_counters") == F.col("_counter"), "left")
            .select("chart_id", "upload_id", "upload_name", "source_field",
                    F.when(F.col("source_field") == TEXT_SOURCE, F.col("script")).otherwise(F.col("_counter_name")).alias("filter_data")))


def chart_list(main: str, key: str, fields: Sequence[str], lookups: Sequence[tuple[str, str, str, Sequence[str]]]) -> FetchSpec:
    """A chart-list spec: left lookups as (table, foreign key, key, fields), a foreign key
    ``lookup.column`` reaching through an earlier lookup."""
    return FetchSpec(main, key, tuple(fields), tuple(Lookup(t, fk=fk, key=k, fields=tuple(f)) for t, fk, k, f in lookups))
