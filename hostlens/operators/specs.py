"""Q15: saved series specs run as one batch over the measurements.

Specs are rows ``(spec_id, options)``.  Options are parsed with ``from_json`` to
a map and merged over the defaults with ``map_zip_with`` (saved value wins;
``map_concat`` would fail on duplicate keys).  All specs run in one plan: every
option is a column.

Options that act on the data: ``hostnames`` (a list or one name; empty: all),
``selected`` / ``plot`` (columns of the frame; blank: the frame's own; rows are
indexed by the frame's time), ``filter`` (a value of the selected column; blank: all rows),
``start_time`` and ``end_time`` (a closed range; blank: open), ``interval`` and
``aggregation`` (positional buckets of the host's rows if the interval is a
multiple of the sample period above it; a bad or blank interval, or a blank or
unknown aggregation, passes rows through).  ``bucket`` = ``time`` in the options
asks for epoch-aligned buckets of ``interval`` seconds instead.  The options
that draw (titles, labels, grid, legend, paths) have no effect on rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.timefmt import parse_time
from hostlens.operators.scan import computed_once, ordinal, slice_count
from hostlens.operators.series import AGGREGATIONS, SAMPLE_PERIOD

# Option defaults used when a saved spec leaves them out.
DEFAULT_OPTIONS = {"selected": "", "plot": "", "filter": "", "hostnames": "", "start_time": "", "end_time": "",
                   "interval": "", "aggregation": "", "bucket": "position"}


def merged_options(specs: DataFrame, defaults: Mapping[str, str] = DEFAULT_OPTIONS,
                   json_col: str = "options") -> DataFrame:
    """``specs`` with the column ``opts``: saved options over the defaults; lists stay JSON text."""
    saved = F.coalesce(F.from_json(F.col(json_col), "map<string,string>"), F.create_map().cast("map<string,string>"))
    dflt = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    merged = F.map_zip_with(dflt, saved, lambda k, d, s: F.coalesce(s, d))
    return specs.withColumn("opts", merged)


def _options(specs: DataFrame) -> DataFrame:
    o = F.col("opts")

    def text(name: str):
        return F.trim(F.coalesce(o[name], F.lit("")))

    hosts = F.coalesce(F.from_json(text("hostnames"), "array<string>"), F.when(text("hostnames") != "", F.array(text("hostnames"))),
                       F.array().cast("array<string>"))
    width = F.coalesce(text("interval").try_cast("bigint"), F.lit(0))
    agg = F.lower(text("aggregation"))
    known = agg.isin(*AGGREGATIONS)
    by_time = text("bucket") == "time"
    whole = (width > SAMPLE_PERIOD) & (F.pmod(width, F.lit(SAMPLE_PERIOD)) == 0)
    return merged_options(specs).select(
        "spec_id", text("selected").alias("_selected"), text("plot").alias("_plot"),
        text("filter").alias("_filter"), F.filter(hosts, lambda h: h != "").alias("_hosts"),
        parse_time(text("start_time")).alias("_from"), parse_time(text("end_time")).alias("_to"),
        F.when(known & by_time & (width > 0), width).alias("_seconds"),
        F.when(known & ~by_time & whole, F.floor(width / SAMPLE_PERIOD)).alias("_rows"), agg.alias("_agg"))


#: Widths of time bins in seconds; a spec takes the first that cuts its range into ``MOST_BINS`` at most.
BIN_SECONDS = (3_600, 57_600, 921_600, 14_745_600, 235_929_600)
MOST_BINS = 17
#: Keys of specs up to this number go to the rows as a broadcast, which leaves out rows that no spec can want.
BROADCAST_KEYS = 200_000


def _named_bin(width: int):
    return lambda b: F.concat(F.lit(f"{width}:"), b.cast("string"))


def _by_bins(rows: DataFrame, keyed: DataFrame, row_keys: Mapping[str, Column]) -> DataFrame:
    """Rows (with their time ``_at``) and the specs of their key whose range overlaps their bin, as an equi-join:
    a spec stands in its bins of one width, a row in one bin of each kind of key and width that is in use.  Specs with
    an open range, or one too long for the widest bins, meet all rows of their key, as they must."""
    keyed = computed_once(keyed)
    start, end = (F.unix_seconds(F.col(c).cast("timestamp")) for c in ("_from", "_to"))
    bins = F.array(F.lit(""))
    at = {"": F.lit("")}
    for width in reversed(BIN_SECONDS):
        first, last = F.floor(start / width), F.floor(end / width)
        fits = F.col("_from").isNotNull() & F.col("_to").isNotNull() & (last - first < MOST_BINS)
        cut = F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), _named_bin(width)))
        bins = F.when(fits, F.coalesce(cut, F.array().cast("array<string>"))).otherwise(bins)
        at[str(width)] = _named_bin(width)(F.floor(F.unix_seconds(F.col("_at").cast("timestamp")) / width))
    specs = keyed.withColumn("_bin", F.explode(bins))
    # at most one row per kind of key and width
    used = keyed.select(F.substring("_k", 1, 1).alias("kind"), F.substring_index(F.get(bins, F.lit(0)), ":", 1).alias("width")).distinct().collect()
    places = [F.struct(row_keys[u.kind].alias("_k"), at[u.width].alias("_bin")) for u in used if u.width is not None]
    places = F.array(*places) if places else F.array().cast("array<struct<_k:string,_bin:string>>")
    placed = rows.select("*", F.explode(F.filter(places, lambda p: p["_bin"].isNotNull())).alias("_p")).select(*rows.columns, "_p.*")
    keys = keyed.select("_k").distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        placed = placed.join(F.broadcast(keys), "_k", "left_semi")
    return placed.join(specs, ["_k", "_bin"]).drop("_bin")


def run_specs(measurements: DataFrame, specs: DataFrame, *, selected: str = "Series", host_col: str = "Hostname",
              time_col: str = "Timestamp", pos_col: str = "pos", value_col: str = "Value",
              columns: Sequence[str] = (), max_specs: int = 10_000) -> DataFrame:
    """(spec_id, host, bucket, Timestamp, Value) of every spec.

    ``columns`` are the frame's columns that specs may name in ``selected`` and
    ``plot`` besides the defaults.  Up to ``max_specs`` specs, times the hosts each lists, are
    broadcast behind that check; more of them are joined as a table, by bins of time.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    names = [c for c in dict.fromkeys([selected, host_col, *columns]) if c not in (time_col, pos_col, value_col)]

    def named(option: str, default: str, kind: str):
        out = F.when(F.col(option) == "", F.col(default).cast(kind))
        for c in dict.fromkeys([default, *columns]):
            out = out.when(F.col(option) == c, F.trim(F.col(c).cast("string")).try_cast(kind) if kind == "double" else F.col(c).cast(kind))
        return out

    # specs and rows meet by equality: on the host where a spec lists hosts, else on the filter value
    # of the frame's own selected column, else (a spec over the whole frame) on a common key
    own = (F.col("_selected") == "") | (F.col("_selected") == selected)
    spec_keys = (F.when(F.size("_hosts") > 0, F.transform(F.array_distinct("_hosts"), lambda h: F.concat(F.lit("h"), h)))
                 .when(own & (F.col("_filter") != ""), F.array(F.concat(F.lit("f"), F.col("_filter")))).otherwise(F.array(F.lit("a"))))
    keyed = _options(specs).withColumn("_k", F.explode(spec_keys)).drop("_hosts")
    time = F.col(time_col).cast("timestamp_ntz")
    rows = measurements.select(*names, time_col, pos_col, value_col)
    row_keys = {"h": F.concat(F.lit("h"), F.coalesce(F.col(host_col), F.lit(""))), "f": F.concat(F.lit("f"), F.coalesce(F.col(selected), F.lit(""))), "a": F.lit("a")}
    # one row per spec and host it lists: a few are broadcast; many meet the rows by bins of time
    many = keyed.limit(max_specs + 1).count() > max_specs
    if not many:
        j = rows.withColumn("_k", F.explode(F.array(*row_keys.values()))).join(F.broadcast(keyed), "_k")
    else:
        # options are dear to read: a table of many specs may come in one file, which one task would read
        keyed = _options(specs.repartition(slice_count(specs))).withColumn("_k", F.explode(spec_keys)).drop("_hosts")
        j = _by_bins(rows.withColumn("_at", time), keyed, row_keys).drop("_at")
    j = j.where((F.col("_from").isNull() | (time >= F.col("_from"))) & (F.col("_to").isNull() | (time <= F.col("_to"))))
    j = j.where((F.col("_filter") == "") | (named("_selected", selected, "string") == F.col("_filter")))
    j = j.select("spec_id", F.col(host_col), time.alias("_t"), pos_col, named("_plot", value_col, "double").alias("_v"), "_agg", "_seconds", "_rows")
    if many:
        j = computed_once(j)        # read below by specs with and without positional buckets
    # positions are needed only by specs with positional buckets
    ranked = ordinal(j.where("_rows is not null").withColumn("_series", F.concat_ws("\u0001", F.col("spec_id").cast("string"), F.col(host_col))),
                     "_series", ["_t", pos_col], name="_rn").drop("_series")
    us = F.timestamp_diff("MICROSECOND", epoch, F.col("_t"))
    rest = j.where("_rows is null").withColumn("_rn", F.lit(None).cast("long"))
    bucketed = ranked.unionByName(rest).withColumn(
        "bucket", F.when(F.col("_rows").isNotNull(), F.floor(F.col("_rn") / F.col("_rows")))
        .when(F.col("_seconds").isNotNull(), F.floor(us / (F.col("_seconds") * 1_000_000)) * F.col("_seconds")).cast("bigint"))
    grouped = bucketed.where("bucket is not null")
    at = F.struct("_t", pos_col)
    g = grouped.groupBy("spec_id", "_agg", host_col, "bucket").agg(
        F.min("_t").alias("_t0"), F.max("_t").alias("_t1"),
        F.max("_v").alias("_max"), F.min("_v").alias("_min"), F.avg("_v").alias("_avg"),
        F.min_by("_v", at).alias("_first"), F.max_by("_v", at).alias("_last"))
    a = F.col("_agg")
    value = (F.when(a == "max", F.col("_max")).when(a == "min", F.col("_min")).when(a.isin("mean", "average"), F.col("_avg"))
             .when(a == "first", F.col("_first")).otherwise(F.col("_last")))
    shown = F.when(a.isin("max", "last"), F.col("_t1")).otherwise(F.col("_t0"))
    passed = bucketed.where("bucket is null").select("spec_id", host_col, "bucket", F.col("_t").alias(time_col), F.col("_v").alias(value_col))
    return g.select("spec_id", host_col, "bucket", shown.alias(time_col), value.alias(value_col)).unionByName(passed)
