"""Change sets applied as set-based DataFrame plans.

A change set is a long table ``(seq, action, pkid, field, value)``.  Rules
per field come from a declared rule table (``TableRule`` rows), not from
parsing DDL text.  Validation is expressions over the change rows joined to
the rule table and to the stored state; nothing loops over records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlens.functions.identity import row_hash
from hostlens.operators.kernels import assign_keys, delete, insert_ignore, update
from hostlens.operators.scan import keyed_scan, slice_count
from hostlens.plans.fetch_spec import list_ids
from hostlens.session import scratch_path

# The messages the reference reports for field errors.
MSG_TOO_LONG = "Data length ({}) greater than DB length of {}"
MSG_NOT_INT = "Required type int but submitted as class 'str'"
MSG_DUPLICATE = "Duplicate data, modify to be unique."
MSG_NO_MULTI_FIELD = "System error: No field found for multi-select"
MSG_NOT_TEXT = "Required type varchar(string) but submitted as {}"
MSG_UNKNOWN_FIELD = 'Unable to validate field "{}"'
#: A message of our own: text that the column's stored type cannot hold.
MSG_NOT_STORED = "Not a value of type {}"
NULL_MARKER = "^NULL^"
ROW_ID = "DT_RowId"


@dataclass(frozen=True)
class FieldRule:
    name: str
    type: str                  # varchar | int | date
    length: int = 0
    unique: bool = False
    required_insert: bool = False
    required_update: bool = False
    has_reqs: bool = False     # the rule carries requirement info (E2d applies)


def rule_table(spark: SparkSession, rules: Sequence[FieldRule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.type, r.length, r.unique, r.required_insert, r.required_update, r.has_reqs) for r in rules],
        "field string, type string, length int, is_unique boolean, required_insert boolean, "
        "required_update boolean, has_reqs boolean")


# E1 ------------------------------------------------------------------------
FORM_KEY = r"^data\[([^\]]*)\]((?:\[[^\]]*\])+)$"


def parse_form(pairs: DataFrame, key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Form keys ``data[pkid][...][field]`` to ``(pkid, path, field, value)`` rows.

    The last bracket is the field.  Many-file keys ``data[k][files][i][id]``
    become field ``files`` with the id as value (gather with ``gather_files``);
    ``<field>-many-count`` rows are kept as field ``<field>-many-count``.
    Keys outside ``data[...]`` (such as ``action``) are dropped.
    """
    k = F.col(key_col)
    pk = F.regexp_extract(k, FORM_KEY, 1)
    parts = F.regexp_extract_all(F.regexp_extract(k, FORM_KEY, 2), F.lit(r"\[([^\]]*)\]"), 1)
    last = F.element_at(parts, -1)
    is_file = (F.size(parts) >= 3) & (last == "id") & F.element_at(parts, -2).rlike(r"^\d+$")
    field = F.when(is_file, F.element_at(parts, 1)).otherwise(last)
    # spread by the number of pairs first: a reading task would else hold all its pairs in one aggregate
    cols = ["pkid", "section", "field", "is_file", "value"]
    return (pairs.where(k.rlike(FORM_KEY))
            .select(pk.alias("pkid"), F.element_at(parts, 1).alias("section"), field.alias("field"),
                    is_file.alias("is_file"), F.col(value_col).alias("value"))
            .repartition(slice_count(pairs), *cols).dropDuplicates(cols))


def form_changes(pairs: DataFrame, key_col: str = "key", value_col: str = "value", pos_col: str = "pos",
                 upload_many: Mapping[str, str] | None = None) -> DataFrame:
    """E1 as the head of the edit pipeline: posted pairs (with their position) to change
    rows ``(seq, action, pkid, field, value)``.

    ``seq`` is the position of a record's first pair, the order in which records
    are applied; ``action`` is the post's own.  A key ``data[pkid]...[field]`` sets
    the field, the last of equal keys wins.  A list key (``...[field][]``) gathers
    its values to comma text.  ``upload_many`` maps the name of a many-file part
    to its field, which gets the posted ids as JSON; their counts are skipped.
    """
    upload_many = dict(upload_many or {})
    k = F.col(key_col)
    names = F.regexp_extract_all(k, F.lit(r"\[([A-Za-z0-9_\-]+)\]"), 1)
    action = pairs.where(k == "action").agg(F.max(value_col).alias("action"))      # one row
    part = F.get(names, F.lit(1))
    file_field = F.try_element_at(F.create_map(*[F.lit(x) for p in upload_many.items() for x in p]), part) if upload_many else F.lit(None).cast("string")
    own = [F.lit(n) for n in upload_many]
    counts = part.endswith("-many-count") & (F.substring_index(part, "-", 1).isin(*own) if own else F.lit(False))
    rows = (pairs.where(k.rlike(r"^data\[") & (F.size(names) >= 2) & F.get(names, F.lit(0)).rlike("^[0-9]+$") & ~counts)
            .select(F.get(names, F.lit(0)).cast("bigint").alias("pkid"), F.coalesce(file_field, F.try_element_at(names, F.lit(-1))).alias("field"),
                    F.when(file_field.isNotNull(), "files").when(k.endswith("[]"), "list").otherwise("text").alias("kind"),
                    F.col(value_col).alias("value"), F.col(pos_col).alias("pos")))
    at = F.struct(F.col("pos"), F.col("value").alias("v"))
    # a group is one field of one record
    gathered = F.array_sort(F.collect_list(F.when(F.col("kind") != "text", at)))
    fields = rows.groupBy("pkid", "field").agg(F.max("kind").alias("kind"), F.min("kind").alias("files"), F.min("pos").alias("pos"),
                                               F.max_by("value", F.when(F.col("kind") == "text", F.col("pos"))).alias("text"), gathered.alias("l"))
    value = (F.when(F.col("files") == "files", F.to_json(F.transform("l", lambda x: F.struct(x["v"].alias("id")))))
             .when(F.col("files") == "list", F.array_join(F.transform("l", lambda x: x["v"]), ",")).otherwise(F.col("text")))
    first = rows.groupBy("pkid").agg(F.min("pos").cast("bigint").alias("seq"))
    return (fields.join(first, "pkid").crossJoin(F.broadcast(action))
            .select("seq", "action", "pkid", "field", value.alias("value")))


def gather_files(rows: DataFrame) -> DataFrame:
    """Many-file rows to one ``array<struct<id>>`` per (pkid, field), sorted."""
    f = rows.where("is_file")
    return f.groupBy("pkid", "field").agg(
        F.array_sort(F.collect_set(F.struct(F.col("value").try_cast("bigint").alias("id")))).alias("ids"))


# E2 ------------------------------------------------------------------------
def validate(changes: DataFrame, rules: Sequence[FieldRule], state: DataFrame, key: str) -> DataFrame:
    """Validate long change rows ``(seq, action, pkid, field, value)``.

    Output: every input row with ``out_value`` (normalised text, or the null
    marker), ``drop`` (field removed from the write) and ``status`` (error text
    or null).  A value must fit its column's stored type (a number its range, a
    date the calendar), so that no later cast can fail.  Unique checks see the
    table as the valid records before a record leave it (create: any owner; edit:
    another owner), as if records were validated and applied one by one; with
    contested values that change hands this runs a few jobs.  Multi-select
    counts are checked (E2g): a missing field of a count above 0 is an error row,
    of a count of 0 a blank row.  An optional column ``kind`` tells what a value
    was submitted as; anything but text, a list or files is an error for text
    fields.
    """
    ch = changes.where(F.col("field") != ROW_ID)
    if "kind" not in ch.columns:
        ch = ch.withColumn("kind", F.lit("text"))
    missing = multi_select_counts(ch.select("seq", "action", "pkid", "field", "value"))
    ch = ch.withColumn("given", F.lit(None).cast("string")).unionByName(missing.where(F.col("add_blank") | F.col("status").isNotNull()).select(
        "seq", "action", "pkid", "field", F.lit("").alias("value"), F.lit("text").alias("kind"), F.col("status").alias("given")))
    # the rule table is declared (one row per field), so broadcasting it is bounded
    j = ch.join(F.broadcast(rule_table(changes.sparkSession, rules)), "field", "left")
    v = F.regexp_replace(F.coalesce(F.col("value"), F.lit("")), "\u00a0", " ")
    blank = v == ""
    act = F.lower(F.col("action"))
    required = F.when(act == "create", F.col("required_insert")).otherwise(F.col("required_update"))
    is_fk = F.col("field").startswith("fk_")
    as_int = F.trim(v).try_cast("bigint")
    length_err = lambda n_len: F.format_string(MSG_TOO_LONG.replace("{}", "%d"), n_len, F.col("length"))
    optional_blank = blank & F.coalesce(F.col("has_reqs"), F.lit(False)) & ~F.coalesce(required, F.lit(False))

    drop = ((optional_blank & is_fk) | ((F.col("type") == "date") & blank)
            | ((F.col("type") == "int") & blank & ~optional_blank & (act == "create"))
            | F.col("field").endswith("-many-count") | (F.col("field") == "row_order"))
    out_value = (F.when(optional_blank & (F.col("type") == "int") & ~is_fk, F.lit("0"))
                 .when((F.col("type") == "int") & blank, F.when(act == "edit", F.lit(NULL_MARKER)))
                 .when(F.col("type") == "int", as_int.cast("string"))
                 .otherwise(v))
    status = (F.when(F.col("given").isNotNull(), F.col("given"))
              .when(F.col("type").isNull() & ~F.col("field").endswith("-many-count") & (F.col("field") != "row_order"),
                     F.format_string(MSG_UNKNOWN_FIELD.replace("{}", "%s"), F.col("field")))
              .when(drop, F.lit(None))
              .when((F.col("type") == "varchar") & ~F.col("kind").isin("text", "list", "files"),
                    F.format_string(MSG_NOT_TEXT.replace("{}", "%s"), F.col("kind")))
              .when((F.col("type") == "varchar") & (F.length(v) > F.col("length")), length_err(F.length(v)))
              .when((F.col("type") == "int") & ~blank & as_int.isNull(), F.lit(MSG_NOT_INT))
              .when((F.col("type") == "int") & ~blank & (F.col("length") > 0) &
                    (F.length(as_int.cast("string")) > F.col("length")),
                    length_err(F.length(as_int.cast("string")))))
    out = j.select("seq", "action", "pkid", "field", "value", "is_unique", out_value.alias("out_value"),
                   drop.alias("drop"), status.alias("status"))
    out = out.withColumn("status", F.when(F.col("status").isNull() & ~F.col("drop"), _unfit(state, rules)).otherwise(F.col("status")))
    return _unique_checks(out, [r.name for r in rules if r.unique], state, key)


def _unfit(state: DataFrame, rules: Sequence[FieldRule]) -> Column:
    """The error of an ``out_value`` that its column's stored type cannot hold, else null."""
    out = F.lit(None).cast("string")
    for name, kind in state.dtypes:
        if kind != "string" and name in [r.name for r in rules]:
            bad = (F.col("field") == name) & (F.col("out_value") != NULL_MARKER) & F.col("out_value").try_cast(kind).isNull()
            out = F.when(bad, F.lit(MSG_NOT_STORED.format(kind))).otherwise(out)
    return out


def _unique_checks(rows: DataFrame, names: Sequence[str], state: DataFrame, key: str) -> DataFrame:
    """E2e / E2f: a claim of a value that another row holds at that moment is a duplicate.

    A row holds its stored value until a valid record changes it, and a record's value from
    then on; a record that sends its row's own value again claims nothing new.  First the claimed and
    stored values are grouped once, by (field, value); those with one owner are free.  Of the others,
    a value whose stored owner is not changed by the batch is held throughout.  Only values
    that may change hands are left for ``_handed_over``.
    """
    if not names:
        return rows.drop("is_unique")
    rows = _written(rows, "validated")      # read several times
    value = F.when(F.col("out_value") != NULL_MARKER, F.col("out_value"))
    new = F.lower("action") == "create"
    # what records write to unique fields, were they applied
    written = rows.where(F.coalesce("is_unique", F.lit(False)) & F.col("status").isNull() & ~F.col("drop")).select(
        F.col("seq").cast("bigint").alias("seq"),
        F.when(new, F.concat(F.lit("new "), F.col("seq").cast("string"))).otherwise(F.col("pkid").cast("string")).alias("owner"), "field", value.alias("held"))
    claims = written.where("held is not null")
    stored = state.select(F.col(key).cast("string").alias("owner"),
                          F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("held"))
                                              for n in names])).alias("_u")).select("owner", "_u.*").where("held is not null")
    by_value = (claims.select("field", "held", "owner", F.lit(1).alias("claimed")).unionByName(stored.withColumn("claimed", F.lit(0)))
                .groupBy("field", "held").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max("claimed").alias("claimed"))
                .where("claimed = 1 and lo != hi").select("field", "held"))
    contested = _written(by_value, "contested")
    holders = _written(stored.join(contested, ["field", "held"], "left_semi"), "holders")
    fixed = (holders.join(written.select("owner", "field").distinct(), ["owner", "field"], "left_anti")
             .groupBy("field", "held").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")))
    asked = claims.join(contested, ["field", "held"], "left_semi").join(fixed, ["field", "held"], "left")
    asked = _written(asked.select("seq", "owner", "field", "held", F.col("lo").isNotNull().alias("settled"),
                                  F.coalesce((F.col("owner") != F.col("lo")) | (F.col("owner") != F.col("hi")), F.lit(False)).alias("dup")), "claims")
    hits = asked.where("dup").select("seq", "field")
    if asked.where("not settled").take(1):
        refused = rows.where(F.col("status").isNotNull()).select(F.col("seq").cast("bigint").alias("seq")).union(hits.select("seq")).distinct()
        hits = hits.unionByName(_handed_over(asked.where("not settled").select("seq", "owner", "field", "held"), written, stored, refused))
    return (rows.join(hits.distinct().withColumn("_dup", F.lit(True)), ["seq", "field"], "left")
            .withColumn("status", F.coalesce("status", F.when(F.col("_dup"), F.lit(MSG_DUPLICATE)))).drop("_dup", "is_unique"))


def _handed_over(claims: DataFrame, written: DataFrame, stored: DataFrame, refused: DataFrame) -> DataFrame:
    """(seq, field) of the duplicates among claims of values that may change hands.

    The timeline of a value: one owner more at a record that brings it to a row, one less at the
    row's next change.  A claim is a duplicate if owners other than its own are left in the running sum
    before it.  Only valid records count, and which are valid is what is asked; so this goes in rounds:
    each takes the records that the last one found valid.  A record's answer depends on earlier
    ones alone, so every round settles at least the next record of each chain of records that depend on each
    other, and the first round that changes nothing is the answer of going record by record.
    """
    first = F.lit(-(1 << 63))
    pairs = claims.select("owner", "field").unionByName(
        stored.join(claims.select("field", "held").distinct(), ["field", "held"], "left_semi").select("owner", "field")).distinct()
    line = _written(written.join(pairs, ["owner", "field"], "left_semi").withColumn("stored", F.lit(False)).unionByName(
        stored.join(pairs, ["owner", "field"], "left_semi").withColumns({"seq": first, "stored": F.lit(True)})), "timeline")
    always = _written(refused, "refused")
    size = line.count()
    bad, found = always, None
    while True:
        own = Window.partitionBy("owner", "field").orderBy("seq", "held")
        counts = F.coalesce(~F.col("_bad"), F.lit(True))
        known = line.join(bad.withColumn("_bad", F.lit(True)), "seq", "left").withColumn("counts", counts)
        steps = known.withColumns({
            "before": F.last(F.when(F.col("counts"), F.struct("held")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)),
            "end": F.first(F.when(F.col("counts"), F.col("seq")), ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))}).where("held is not null")
        # one row each for the claim itself, for the owner more at its record and for the owner less at the row's next change
        event = lambda when, seq, n, check: F.when(when, F.struct(seq.alias("at"), F.lit(n).alias("n"), F.lit(check).alias("check")))
        is_claim, seq = F.col("seq") > first, F.col("seq")
        events = F.array(event(is_claim, seq, 0, True), event(F.col("counts"), seq, 1, False), event(F.col("counts") & F.col("end").isNotNull(), F.col("end"), -1, False))
        rows = steps.select(F.concat_ws("\u0001", "field", "held").alias("_value"), "field", F.coalesce(F.col("before.held") == F.col("held"), F.lit(False)).cast("int").alias("mine"),
                            F.explode(F.filter(events, lambda e: e.isNotNull())).alias("_e")).select("_value", "field", "mine", "_e.*")
        scanned = _owners(rows, size)
        dups = _written(scanned.where(F.col("check") & (F.col("owners") > F.col("mine"))).select(F.col("at").alias("seq"), "field").distinct(), "duplicates")
        now = always.union(dups.select("seq")).distinct()
        if found is not None:
            both = now.withColumn("_now", F.lit(True)).join(bad.withColumn("_then", F.lit(True)), "seq", "full")
            if not both.where("_now is null or _then is null").take(1):
                return dups.join(claims.select("seq", "field").distinct(), ["seq", "field"], "left_semi")
        bad, found = now, dups


#: Timelines up to this many rows are summed in a window per value; longer ones in slices, whatever a value's share.
SMALL_TIMELINE = 100_000


def _owners(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the number of owners of the value before each check."""
    order = [F.col("at"), (~F.col("check")).cast("int"), F.col("field"), F.col("mine"), F.col("n")]
    if size > int(rows.sparkSession.conf.get("hostlens.changes.smallTimeline", str(SMALL_TIMELINE))):
        return keyed_scan(rows, "_value", order, sums={"owners": F.col("n")})
    return rows.withColumn("owners", F.sum("n").over(Window.partitionBy("_value").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def record_status(validated: DataFrame) -> DataFrame:
    """Per record: ``valid`` and ``errors array<struct<name,status>>`` (sorted)."""
    return validated.groupBy("seq", "action", "pkid").agg(
        F.array_sort(F.collect_list(F.when(F.col("status").isNotNull(),
                                           F.struct(F.col("field").alias("name"), F.col("status").alias("status"))))
                     ).alias("errors")).withColumn("valid", F.size("errors") == 0)


def multi_select_counts(record_fields: DataFrame) -> DataFrame:
    """E2g: ``<f>-many-count`` > 0 without field ``<f>`` is an error; 0 adds a blank ``<f>``.

    Input long rows ``(seq, pkid, field, value)``, with ``action`` or not; output error
    rows and added blank rows.
    """
    own = ["seq", *(["action"] if "action" in record_fields.columns else []), "pkid"]
    counts = (record_fields.where(F.col("field").endswith("-many-count"))
              .select(*own, F.regexp_replace("field", "-many-count$", "").alias("target"),
                      F.col("value").try_cast("int").alias("n")))
    present = record_fields.select("seq", F.col("field").alias("target")).distinct().withColumn("_has", F.lit(True))
    j = counts.join(present, ["seq", "target"], "left")
    has = F.coalesce(F.col("_has"), F.lit(False))
    return j.select(*own, F.col("target").alias("field"),
                    F.when((F.col("n") > 0) & ~has, F.lit(MSG_NO_MULTI_FIELD)).alias("status"),
                    ((F.col("n") == 0) & ~has).alias("add_blank"))


# E3 ------------------------------------------------------------------------
def new_lookup_values(labels: DataFrame, lookup: DataFrame, label_col: str, key_col: str) -> DataFrame:
    """Unknown labels get keys max + rank (by label); returns (label, key, is_new)."""
    distinct = labels.select(F.col(label_col).alias(label_col)).where(F.col(label_col).isNotNull()).distinct()
    known = distinct.join(lookup.select(label_col, key_col), label_col, "inner").withColumn("is_new", F.lit(False))
    unknown = distinct.join(lookup.select(label_col), label_col, "left_anti")
    fresh = assign_keys(lookup.select(key_col), unknown, key_col, [label_col]).withColumn("is_new", F.lit(True))
    return known.unionByName(fresh.select(label_col, key_col, "is_new"))


@dataclass(frozen=True)
class Tag:
    """A lookup that takes new labels: its table, label column and key column."""
    table: DataFrame
    label: str
    key: str = "pkid"


def resolve_tags(changes: DataFrame, tags: Mapping[str, Tag]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """E3 before validation: text in a field ``fk_<table>`` of a tag-enabled lookup is replaced by
    its key; unknown labels are added to the lookup.  Returns the changes and the lookups' next
    states."""
    after: dict[str, DataFrame] = {}
    for name, tag in tags.items():
        mine = (F.col("field") == f"fk_{name}") & (F.coalesce("value", F.lit("")) != "") & F.trim("value").try_cast("bigint").isNull()
        labels = changes.where(mine).select(F.col("value").alias(tag.label)).distinct()
        known = new_lookup_values(labels, tag.table, tag.label, tag.key)
        after[name] = tag.table.unionByName(known.where("is_new").select(F.col(tag.key).cast(dict(tag.table.dtypes)[tag.key]).alias(tag.key), tag.label),
                                            allowMissingColumns=True)
        keys = known.select(F.lit(f"fk_{name}").alias("field"), F.col(tag.label).alias("value"), F.col(tag.key).cast("string").alias("_key"))
        changes = changes.join(keys, ["field", "value"], "left").withColumn("value", F.coalesce("_key", "value")).drop("_key")
    return changes, after


# E7 ------------------------------------------------------------------------
def read_back(requested: DataFrame, stored: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Requested vs stored values per (key, field): rows where they differ.

    Both sides are first reduced to a digest per bucket of keys (count and sum of the rows' hashes); only rows
    of buckets that differ are compared, and only their fields spread out.  Equal tables cost one
    aggregate each.  ``buckets`` is the size of the two digests, which are compared when this is called.
    """
    cols = [c for c in requested.columns if c != key]

    def digests(df: DataFrame, side: str) -> DataFrame:
        # in text, as fields are compared; a second hash keeps sums from cancelling out
        texts = df.select(F.col(key).cast("string").alias("_k"), *[F.col(c).cast("string").alias(c) for c in cols])
        row = row_hash(texts)
        return (texts.select(F.pmod(F.xxhash64("_k"), F.lit(buckets)).alias("_b"), F.shiftright(row, 20).alias("_hi"), row.bitwiseAND(F.lit((1 << 20) - 1)).alias("_lo"))
                .groupBy("_b").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col("_hi").cast("decimal(38,0)")).alias("hi"),
                                            F.sum("_lo").alias("lo")).alias(side)))

    both = digests(requested, "r").join(digests(stored.select(key, *cols), "s"), "_b", "full")
    bad = [r["_b"] for r in both.where(~F.col("r").eqNullSafe(F.col("s"))).select("_b").collect()]      # at most ``buckets``

    def fields(df: DataFrame, name: str) -> DataFrame:
        mine = df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).isin(bad)) if len(bad) < buckets else df
        return mine.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in cols])).alias("_f")).select(key, "_f.*")

    j = fields(requested, "requested").join(fields(stored, "stored"), [key, "field"], "full")
    return j.where(~F.col("requested").eqNullSafe(F.col("stored")))


# E8 / E9 -------------------------------------------------------------------
def reference_columns(tables: Mapping[str, DataFrame], table: str) -> list[tuple[str, DataFrame, str]]:
    """The columns that refer to ``table``: ``fk_<table>``, one key, and ``fk_<table>_list``, comma text of keys."""
    wanted = (f"fk_{table}", f"fk_{table}_list")
    return [(name, df, c) for name, df in tables.items() for c in df.columns if c in wanted]


def dependency_counts(keys: DataFrame, key: str, refs: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Count referencing rows per (key, referencing table).  ``refs``: (table name, table, column);
    a column that ends in ``_list`` holds lists of keys, and a row counts once per key.
    Rows are first reduced to the asked keys by a semi join, then counted."""
    asked = keys.select(key).distinct()
    parts = []
    for name, df, fk in refs:
        ref = (df.select(F.explode(F.array_distinct(list_ids(fk))).alias(key)) if fk.endswith("_list") else df.select(F.col(fk).alias(key)))
        parts.append(ref.join(asked, key, "left_semi").withColumn("ref_table", F.lit(name)))
    if not parts:
        return asked.select(key, F.lit(0).cast("bigint").alias("n"), F.lit("").alias("ref_table")).limit(0)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key, "ref_table").agg(F.count(F.lit(1)).alias("n")).select(key, "n", "ref_table")


def guarded_delete(state: DataFrame, requested: DataFrame, key: str,
                   refs: Sequence[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Delete requested keys that nothing references; report the others.

    Returns (next state, report(key, deleted, n_dependents))."""
    req = requested.select(key).distinct()
    deps = dependency_counts(req, key, refs).groupBy(key).agg(F.sum("n").alias("n_dependents"))
    rep = req.join(deps, key, "left").select(key, F.coalesce("n_dependents", F.lit(0)).cast("bigint").alias("n_dependents"))
    rep = rep.withColumn("deleted", F.col("n_dependents") == 0)
    return delete(state, rep.where("deleted"), key), rep


# E10 -----------------------------------------------------------------------
def reorder(state: DataFrame, mapping: DataFrame, key: str, order_col: str, names_col: str) -> DataFrame:
    """New order of row r = present order of the row r names (self join on a snapshot)."""
    snap = state.select(F.col(key).alias(names_col), F.col(order_col).alias("_named_order"))
    m = mapping.select(key, names_col).join(snap, names_col, "inner").select(key, "_named_order")
    return (state.join(m, key, "left")
            .withColumn(order_col, F.coalesce(F.col("_named_order"), F.col(order_col))).drop("_named_order"))


def is_reorder(changes: DataFrame) -> bool:
    """E10 applies only when there are changes and every record holds the row id alone (one probe)."""
    return not changes.where(F.col("field") != ROW_ID).take(1) and bool(changes.take(1))


def reorder_changes(state: DataFrame, changes: DataFrame, key: str, order_col: str) -> DataFrame:
    """E10 of a post: record r takes the present order of the row its row id names; a post with
    any other field leaves the order alone."""
    if not is_reorder(changes):
        return state
    kind = dict(state.dtypes)[key]
    mapping = changes.groupBy(F.col("pkid").cast(kind).alias(key)).agg(F.max_by("value", "seq").try_cast(kind).alias("_names"))
    return reorder(state, mapping, key, order_col, "_names")


# E12 -----------------------------------------------------------------------
def until_first_bad(validated: DataFrame) -> DataFrame:
    """Rows of records before the first invalid record (by seq)."""
    bad = validated.where(F.col("status").isNotNull()).agg(F.min("seq").alias("_first_bad"))
    return (validated.crossJoin(F.broadcast(bad))
            .where(F.col("_first_bad").isNull() | (F.col("seq") < F.col("_first_bad"))).drop("_first_bad"))


def valid_only(validated: DataFrame) -> DataFrame:
    """Alternative mode: apply every valid record."""
    bad = validated.where(F.col("status").isNotNull()).select("seq").distinct()
    return validated.join(bad, "seq", "left_anti")


# E6 ------------------------------------------------------------------------
def stamp_scope(rows: DataFrame, scope_col: str, active) -> DataFrame:
    """Creates in a scoped page get the active scope written into their scope column."""
    return rows.withColumn(scope_col, F.lit(active))


# E2i -----------------------------------------------------------------------
# The coded field and the flag fields each code expands to.
DEVICE_TYPE_CODES = {"0": {"ios": "0", "server": "0"},
                     "1": {"ios": "1", "server": "0"},
                     "2": {"ios": "0", "server": "1"}}


def expand_coded(changes: DataFrame, field: str = "device_type", codes=None) -> DataFrame:
    """A coded field becomes the fields its code stands for (joined to a declared
    code table); the coded field itself is removed, unknown codes add nothing."""
    codes = codes or DEVICE_TYPE_CODES
    spark = changes.sparkSession
    table = spark.createDataFrame([(c, f, v) for c, m in codes.items() for f, v in m.items()],
                                  "_code string, _field string, _value string")
    coded = changes.where(F.col("field") == field)
    # the code table is declared: a bounded broadcast
    added = (coded.join(F.broadcast(table), F.col("value") == F.col("_code"))
             .withColumn("field", F.col("_field")).withColumn("value", F.col("_value"))
             .drop("_code", "_field", "_value"))
    return changes.where(F.col("field") != field).unionByName(added)


# E4 ------------------------------------------------------------------------
def edits_to_changes(validated: DataFrame, fields: Sequence[str], key: str = "pkid") -> DataFrame:
    """Valid edit records (every field of the record valid) to the wide change
    form of ``kernels.update``: one row per key, a value and a ``_set_`` flag per
    field; the null marker becomes NULL.  Groups are one record's fields."""
    ok = valid_only(validated).where(~F.col("drop") & (F.lower("action") == "edit"))
    order = F.col("seq")
    aggs = []
    for f in fields:
        mine = F.col("field") == f
        aggs.append(F.max_by("out_value", F.when(mine, order)).alias(f))
        aggs.append(F.bool_or(mine).alias("_set_" + f))
    w = ok.groupBy(F.col("pkid").alias(key)).agg(*aggs)
    for f in fields:
        w = w.withColumn(f, F.when(F.col(f) != NULL_MARKER, F.col(f)))
    return w


# E5 ------------------------------------------------------------------------
def creates_to_rows(state: DataFrame, validated: DataFrame, fields: Sequence[str], key: str, stop: bool = False) -> DataFrame:
    """Valid create records as rows with their assigned key: (seq, key, fields).  The key and
    fields that are left out or null stay null; keys follow ``seq``.  Groups are one record's fields."""
    ok = (until_first_bad(validated) if stop else valid_only(validated)).where(~F.col("drop") & (F.lower("action") == "create"))
    types = dict(state.dtypes)
    rows = ok.groupBy("seq").agg(*[F.max(F.when(F.col("field") == f, F.col("out_value"))).alias(f) for f in fields if f != key])
    keyed = assign_keys(state, rows, key, ["seq"])
    return keyed.select("seq", F.col(key).cast(types[key]).alias(key), *[F.col(f).try_cast(types[f]).alias(f) for f in fields if f != key])


# E13 -----------------------------------------------------------------------
def seed(state: DataFrame | None, rows: DataFrame, unique: str, key: str | None = None) -> DataFrame:
    """Create a table if absent and insert fixed rows whose unique value is not there yet; with ``key``
    new rows get keys in the order of their unique value."""
    if state is None:
        state = rows.limit(0) if key is None else rows.limit(0).select(F.lit(None).cast("bigint").alias(key), "*")
    if key is None:
        return insert_ignore(state, rows, unique)
    new = rows.dropDuplicates([unique]).join(state.select(unique), unique, "left_anti")
    return state.unionByName(assign_keys(state, new, key, [unique]).select(*state.columns))


# the whole pipeline ----------------------------------------------------------
@dataclass(frozen=True)
class Edited:
    """What a batch of changes made of a table."""
    state: DataFrame                                       # next state
    records: DataFrame                                     # seq, action, pkid, valid, errors
    created: DataFrame                                     # seq and the assigned key
    lookups: dict[str, DataFrame] = field(default_factory=dict)     # next states of tag lookups


def apply_edits(state: DataFrame, changes: DataFrame, rules: Sequence[FieldRule], key: str, *, tags: Mapping[str, Tag] | None = None,
                codes: Mapping[str, Mapping] | None = None, scope: tuple[str, object] | None = None, stop: bool = True) -> Edited:
    """E1 rows to the next table state: coded fields (E2i), new lookup labels (E3), validation
    (E2 with E2g), then records before the first bad one, or with ``stop=False`` every
    valid record: edits (E4, K4) and creates (E5, K1), stamped with the scope (E6).
    """
    for name, table in (codes or {}).items():
        changes = expand_coded(changes, name, table)
    changes, lookups = resolve_tags(changes, tags or {})
    checked = validate(changes, rules, state, key)
    fields = [r.name for r in rules if r.name in state.columns and r.name != key]
    good = until_first_bad(checked) if stop else checked
    edits = edits_to_changes(good, fields, key)
    changed = update(state, edits, key, fields)
    made = creates_to_rows(state, good, fields, key)
    rows = stamp_scope(made, *scope) if scope else made
    full = changed.unionByName(rows.drop("seq").select(*[F.col(c).cast(t) for c, t in state.dtypes if c in rows.columns]), allowMissingColumns=True)
    return Edited(full, record_status(checked), made.select("seq", key), lookups)
