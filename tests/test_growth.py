"""Steps whose cost per task must not follow the whole table: host files, scans, specs, forms, addresses."""

import os

from pyspark.sql import functions as F

from hostlens.functions.address import address_to_name
from hostlens.operators.changes import parse_form
from hostlens.operators.function_scan import function_scan
from hostlens.operators.specs import run_specs
from hostlens.plans.template import extract
from hostlens.session import scratch_path
from hostlens.sources.sinks import write_lines_per_host


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_host_files_are_those_of_sparks_writer(spark):
    lines = spark.createDataFrame([("b", 2, "zwei"), ("a", 1, 'x,"y"'), ("b", 1, "eins"), (None, 1, "none"), ("a", None, "head"), ("b", 3, ""), ("a", 2, None)],
                                  "host string, o int, value string")
    ours, sparks = scratch_path(spark, "ours"), scratch_path(spark, "sparks")
    write_lines_per_host(lines, ["o"], ours, 3)
    (lines.repartition("host").sortWithinPartitions("host", F.col("o").asc_nulls_first()).select("host", "value").write.partitionBy("host").text(sparks))

    def found(root):
        out = {}
        root = root.removeprefix("file:")
        for d in os.listdir(root):
            if d.startswith("host="):
                (name,) = [f for f in os.listdir(f"{root}/{d}") if not f.startswith(".")]
                out[d] = open(f"{root}/{d}/{name}", "rb").read()
        return out

    assert found(ours) == found(sparks) and len(found(ours)) == 3
    # the tasks write the files: no checksum file, and nothing hidden is left behind
    assert not [f for d, _, fs in os.walk(ours.removeprefix("file:")) for f in fs if f.startswith(".")]


def test_places_in_a_file_do_not_hold_its_name(spark):
    lines = spark.createDataFrame([("f1", 0, "h1#"), ("f1", 1, "n 5"), ("f2", 0, "n 6"), ("f2", 1, "n 7")], "file string, line_no int, line string")
    template = "Value Filldown host (\\S+)\nValue Required n (\\d+)\n\nStart\n  ^${host}#\n  ^n ${n} -> Record\n"
    out = extract(lines, template)
    assert sorted(tuple(r) for r in out.select("file", "Host", "N").collect()) == [("f1", "h1", "5"), ("f2", "", "6"), ("f2", "", "7")]
    assert "at:struct<_o0" in "".join(f"{f.name}:{f.dataType.simpleString()}" for f in _scan_input(spark, lines, template))
    across = extract(lines, template, carry_across_files=True)
    assert sorted(tuple(r) for r in across.select("file", "Host", "N").collect()) == [("f1", "h1", "5"), ("f2", "h1", "6"), ("f2", "h1", "7")]


def _scan_input(spark, lines, template):
    from hostlens.plans import template as plan
    seen, scan = [], plan.keyed_scan

    def watched(df, *args, **kw):
        seen.extend(df.select(*kw["fills"].values()).schema.fields)
        return scan(df, *args, **kw)

    plan.keyed_scan = watched
    try:
        extract(lines, template)
    finally:
        plan.keyed_scan = scan
    return seen


def test_a_function_scan_sorts_a_slice_once(spark):
    df = spark.range(40).select((F.col("id") % 3).alias("k"), "id")
    plan = _plan(function_scan(df, "k", ["id"], F.array(F.lit(1), F.lit(0)), states=2, partitions=2))
    # by place of the rows, and by place within the slices they compose: each once
    assert [l.count("_scan_role") for l in plan.splitlines() if "Sort [_scan_part" in l and "_sk0" in l] == [1, 0]


def test_rows_that_no_spec_wants_are_not_shuffled(spark):
    rows = spark.range(500).select(F.col("id").alias("pos"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).cast("timestamp_ntz").alias("Timestamp"),
                                   (F.col("id") % 50).cast("string").alias("Hostname"), F.lit("x").alias("Series"), F.col("id").cast("double").alias("Value"))
    specs = spark.createDataFrame([(i, '{"hostnames": "3", "start_time": "2024-01-01 00:00:00", "end_time": "2024-01-01 0%d:00:00"}' % i) for i in (1, 2, 3)],
                                  "spec_id long, options string")
    from hostlens.operators import specs as module
    met, once = [], module.computed_once

    def watched(df):
        met.append(_plan(df))
        return once(df)

    module.computed_once = watched
    try:
        got = run_specs(rows, specs, max_specs=0)
    finally:
        module.computed_once = once
    assert sorted((r.spec_id, r.pos) for r in got.selectExpr("spec_id", "cast(Value as int) as pos").collect()) == [(1, 3), (1, 53), (2, 3), (2, 53), (2, 103), (3, 3), (3, 53), (3, 103), (3, 153)]
    # hosts of the specs are known to the rows before they are shuffled, and no key or width is made that no spec has
    assert any("LeftSemi" in p for p in met) and not any("concat(f, " in p or "235929600" in p.split("LeftSemi")[-1].split("Exchange")[0] for p in met[-1:])


def test_form_pairs_are_spread_before_they_are_aggregated(spark):
    pairs = spark.range(100).select(F.format_string("data[%d][main][n]", F.col("id") % 50).alias("key"), (F.col("id") % 2).cast("string").alias("value")).coalesce(1)
    out = parse_form(pairs)
    assert out.count() == 50
    plan = _plan(out)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("HashAggregate") < plan.index("Exchange")
    assert "HashAggregate" not in plan[plan.index("Exchange"):]


def test_texts_without_an_address_are_not_joined(spark):
    docs = spark.createDataFrame([(1, "at 10.0.0.1."), (2, "none"), (3, None), (4, "at 10.0.0.9")], "id long, t string")
    hosts = spark.createDataFrame([("10.0.0.1", "one"), ("10.0.0.2", "two")], "ip string, hostname string")
    out = address_to_name(docs, "t", hosts)
    assert sorted((r.id, r.t) for r in out.collect()) == [(1, "at one."), (2, "none"), (3, None), (4, "at 10.0.0.9")]
    assert out.columns == ["id", "t"] and "Union" in _plan(out)
