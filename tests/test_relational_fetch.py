"""QuerySpec, FetchSpec, natural sort, change sets on small fixtures."""

import pytest
from pyspark.sql import functions as F

from hostlens.functions.magnitude import add_magnitude
from hostlens.operators import changes as E
from hostlens.operators import kernels as K
from hostlens.operators.ordering import natural_rank
from hostlens.plans.fetch_spec import FetchSpec, Lookup, fetch, nest_dotted, parse_key_filter
from hostlens.plans.query_spec import JoinSpec, QuerySpec


def test_query_spec_rejects_free_comparators(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        QuerySpec("a", "x", joins=[JoinSpec("a", "y", "x.k", " like ", "k")]).apply({"a": a})


def test_key_filter_parsing():
    assert parse_key_filter(3) == [3] and parse_key_filter("1, 2,3") == [1, 2, 3] and parse_key_filter([4]) == [4]
    with pytest.raises(ValueError):
        parse_key_filter("1,x")


def test_list_lookup_fixture(spark):
    main = spark.createDataFrame([(1, "1,3,7"), (2, None), (3, ""), (4, "9"), (5, "2,2")], "pkid long, lst string")
    look = spark.createDataFrame([(1, "b, with comma"), (2, "same"), (3, "a"), (7, "same")], "pkid long, name string")
    spec = FetchSpec("m", "pkid", ("pkid",), (Lookup("l", fk="lst", label=("name",), kind="list"),))
    rows = {r.DT_RowId: [(e.value, e.label) for e in r.l] for r in fetch(spec, {"m": main, "l": look}).collect()}
    assert rows["1"] == [(3, "a"), (1, "b, with comma"), (7, "same")]
    assert rows["2"] == [] and rows["3"] == [] and rows["4"] == [] and rows["5"] == [(2, "same")]


def test_nest_dotted(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`a.b` int, c string, `a.d` int")
    r = nest_dotted(df).first()
    assert r.c == "x" and r.a.b == 1 and r.a.d == 2


def test_natural_order_fixture(spark):
    vals = ["x10", "x9", "x09", " x1", "10", "9", "abc", "x1y2", "x1y10", "<b>x2</b>"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v string")
    got = [r.v for r in natural_rank(df, "v", "id").orderBy("rank").collect()]
    # numbers before text; digit runs by value, those that start with 0 as text before them; markup is plain text here
    assert got == ["9", "10", "<b>x2</b>", "abc", "x09", " x1", "x1y2", "x1y10", "x9", "x10"]
    got_html = [r.v for r in natural_rank(df, "v", "id", strip_html=True).orderBy("rank").collect()]
    assert got_html.index("<b>x2</b>") == got_html.index("x1y10") + 1


# worked by hand from the comparison rules: each value sorts before the next
NATURAL = ["-1000", "-20", "-3.25", "-3", "-0.5", "", "0.25", "0.5", "007", "1", "1.25", "1.5", "2", "9", "9.75", "10", "10%", "99", "1e3", "2e3", "2001",
           "10 000", "a", "a01", "a1", "a1b", "a1b2", "a1b10", "a2", "a10", "a10.5", "a99999999999999999999", "a100000000000000000000", "a 2", "b1", "b-1"]


def test_natural_order_by_hand(spark):
    from hostlens.functions.natural import natural_key
    order = [v for v in NATURAL if v not in ("10 000",)]      # one number with a space in it is three pieces
    order[order.index("10%"):order.index("10%") + 1] = []     # equal to 10
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "id long, v string").repartition(5)
    got = [r.v for r in df.orderBy(natural_key("v")).collect()]
    assert len(order) >= 30 and got == order
    same = spark.createDataFrame([("10", "10%"), ("5", "5.0"), ("2000", "2e3"), (" 7 ", "7")], "a string, b string")
    assert all(r[0] == r[1] for r in same.select(natural_key("a"), natural_key("b")).collect())


def test_magnitude_values(spark):
    vals = [0, 999, 1000, 1005, 1015, 1025, 12350, 123456, -2500000, 10 ** 17, 1152, None]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    out = add_magnitude(add_magnitude(df, "x", "m"), "x", "b", base=1024)
    got = {r.x: (r.m, r.b) for r in out.collect()}
    # expected text worked by hand from the formula and C-style rounding of the double
    assert got[0] == ("0", "0") and got[999][0] == "1.00K" and got[1000][0] == "1.00K"
    assert got[1005][0] == "1.00K" and got[1015][0] == "1.01K" and got[1025][0] == "1.02K"
    assert got[12350][0] == "12.3K" and got[123456][0] == "0.12M" and got[-2500000][0] == "-2.50M"
    assert got[10 ** 17][0] == "100P" and got[None] == (None, None) and got[1000][1] == "0.98K"
    assert got[1152][1] == "1.12K"           # 1152 / 1024 = 1.125 exactly: ties to even


def test_magnitudes_round_like_c(spark):
    import random
    rng = random.Random(4)
    vals = [rng.randint(1, 10 ** rng.randint(1, 16)) for _ in range(2000)] + [k * 5 + 1000 for k in range(400)] + [k * 50_000 + 5_000 for k in range(400)]

    def by_hand(x):
        mag = len(str(x)) - 1
        return "%.*f%s" % (1 if mag % 3 == 1 else 2, x / 1000 ** ((mag + 1) // 3), ["", "K", "M", "G", "T", "P"][(mag + 1) // 3])

    got = {r.x: r.m for r in add_magnitude(spark.createDataFrame([(v,) for v in vals], "x long"), "x", "m").collect()}
    assert all(got[v] == by_hand(v) for v in vals)


def test_chart_magnitudes(spark):
    from math import log
    vals = [7, 999, 1000, 1023, 1100, 123456, 10 ** 7, 987654321, 5 * 10 ** 12]

    def by_hand(x):
        mag = int(log(x, 10.24))
        return ("%2.1f" if mag % 3 == 1 else "%1.2f") % (x / 1000 ** ((mag + 1) // 3)) + ["", "K", "M", "G", "T", "P"][(mag + 1) // 3]

    got = {r.x: r.m for r in add_magnitude(spark.createDataFrame([(v,) for v in vals], "x long"), "x", "m", chart=True).collect()}
    assert got == {v: by_hand(v) for v in vals}


def test_change_validation_fixture(spark):
    state = spark.createDataFrame([(1, "alpha", 5), (2, "beta", 6)], "pkid long, name string, num long")
    ch = spark.createDataFrame([
        (1, "edit", 1, "name", "alpha"),            # same owner: fine
        (2, "edit", 2, "name", "alpha"),            # owned by another key
        (3, "create", 9, "name", "beta"),           # stored duplicate
        (4, "create", 10, "name", "toolongvalue"),  # over the length
        (5, "edit", 1, "num", ""),                  # blank int on edit -> null marker
        (6, "create", 11, "num", ""),               # blank int on create -> dropped
        (7, "edit", 1, "num", "x1"),                # not an int
        (8, "edit", 1, "bogus", "1"),               # unknown field
        (9, "edit", 1, "name", "new name"),    # non-breaking space
        (10, "create", 12, "name", "gamma"), (11, "create", 13, "name", "gamma"),   # duplicate inside the batch
    ], "seq long, action string, pkid long, field string, value string")
    rules = [E.FieldRule("name", "varchar", 10, unique=True), E.FieldRule("num", "int", 3)]
    v = {r.seq: r for r in E.validate(ch, rules, state, "pkid").collect()}
    assert v[1].status is None and v[2].status == E.MSG_DUPLICATE and v[3].status == E.MSG_DUPLICATE
    assert v[4].status == "Data length (12) greater than DB length of 10"
    assert v[5].out_value == E.NULL_MARKER and not v[5].drop and v[6].drop
    assert v[7].status == E.MSG_NOT_INT and v[8].status == 'Unable to validate field "bogus"'
    assert v[9].out_value == "new name" and v[10].status is None and v[11].status == E.MSG_DUPLICATE


def test_kernels_roundtrip(spark):
    state = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, n string, v double")
    ch = spark.createDataFrame([(1, None, True, 9.0, False)], "k long, n string, _set_n boolean, v double, _set_v boolean")
    upd = {r.k: (r.n, r.v) for r in K.update(state, ch, "k", ["n", "v"]).collect()}
    assert upd == {1: (None, 1.0), 2: ("b", 2.0)}                     # null marker vs absent
    aff = K.affected(state, K.update(state, ch, "k", ["n", "v"]), "k").first()
    assert (aff.n_inserted, aff.n_deleted, aff.n_updated) == (0, 0, 1)
    new = K.append_with_keys(state, spark.createDataFrame([("c", 3.0), ("d", 4.0)], "n string, v double"), "k", ["n"])
    assert sorted(r.k for r in new.collect()) == [1, 2, 3, 4]
    inv = K.delete(new, spark.createDataFrame([(3,), (4,)], "k long"), "k")   # change then inverse
    assert sorted(map(tuple, inv.collect())) == sorted(map(tuple, state.collect()))


def test_multi_select_counts_and_form_keys(spark):
    rows = spark.createDataFrame([(1, 1, "files-many-count", "2"), (1, 1, "files", "7"),
                                  (2, 2, "tags-many-count", "1"),
                                  (3, 3, "tags-many-count", "0")], "seq long, pkid long, field string, value string")
    got = {r.seq: (r.field, r.status, r.add_blank) for r in E.multi_select_counts(rows).collect()}
    assert got[1] == ("files", None, False) and got[2] == ("tags", E.MSG_NO_MULTI_FIELD, False)
    assert got[3] == ("tags", None, True)
    pairs = spark.createDataFrame([("action", "edit"), ("data[12][main][name]", "x"), ("data[12][files][0][id]", "4"),
                                   ("data[12][files][1][id]", "2"), ("data[12][files-many-count]", "2")],
                                  "key string, value string")
    parsed = E.parse_form(pairs)
    assert {(r.pkid, r.field, r.value, r.is_file) for r in parsed.collect()} == {
        ("12", "name", "x", False), ("12", "files", "4", True), ("12", "files", "2", True),
        ("12", "files-many-count", "2", False)}
    ids = E.gather_files(parsed).first()
    assert [e.id for e in ids.ids] == [2, 4]


def test_publish_versions_and_pointer(spark):
    import tempfile
    root = tempfile.mkdtemp(prefix="hl-pub-")
    v1 = K.publish(spark, spark.createDataFrame([(1, "a")], "k long, n string"), root, "t")
    cur = K.current(spark, root, "t")
    v2 = K.publish(spark, K.upsert(cur, spark.createDataFrame([(2, "b")], "k long, n string"), "k"), root, "t")
    assert v1 != v2 and sorted(map(tuple, K.current(spark, root, "t").collect())) == [(1, "a"), (2, "b")]
    assert spark.read.parquet(v1).count() == 1          # the old version is untouched


def test_validation_partitions_every_row(spark):
    from hostlens.registered.changes_q import RULES, change_rows
    from hostlens.registry import table
    from tests.conftest import SF
    ch = change_rows(spark, SF)
    v = E.validate(ch, RULES, table(spark, SF, "customer"), "c_custkey")
    total = ch.where("field <> 'DT_RowId'").count()
    ok = v.where("status IS NULL").count()
    bad = v.where("status IS NOT NULL").count()
    assert ok + bad == total and bad > 0


def test_query_parameters_are_bound_values(spark):
    t = spark.createDataFrame([(1, "it's"), (2, ":name"), (3, "c")], "k int, n string")
    spec = QuerySpec("t", "x", select=["x.k AS k", ":add + x.k AS s"], where="x.n = :name OR x.n = ':name'", params={"name": "it's", "add": 10})
    assert sorted(map(tuple, spec.apply({"t": t}).collect())) == [(1, 11), (2, 12)]
    grouped = QuerySpec("t", group_by=["k % :m AS r"], aggregates=["count(*) AS n"], having="n >= :least", params={"m": 2, "least": 2})
    assert [tuple(r) for r in grouped.apply({"t": t}).collect()] == [(1, 2)]
    star = QuerySpec("t", where="k > :least", params={"least": 2}).apply({"t": t})
    assert star.columns == ["k", "n"] and star.count() == 1
    with pytest.raises(ValueError):
        QuerySpec("t", where="k > :other", params={"least": 2}).apply({"t": t})


def test_unbounded_all_pairs_joins_are_refused(spark):
    t = spark.createDataFrame([(1,), (2,)], "k int")
    for how, op in (("cross", "="), ("inner", "<")):
        with pytest.raises(ValueError):
            QuerySpec("t", "a", joins=[JoinSpec("t", "b", "a.k", op, "k", how)]).apply({"t": t})
    out = QuerySpec("t", "a", select=["a.k AS x", "b.k AS y"], joins=[JoinSpec("t", "b", "a.k", "<", "k", max_rows=2)]).apply({"t": t})
    assert [tuple(r) for r in out.collect()] == [(1, 2)]


def test_raw_sql_touches_no_view(spark):
    from hostlens.plans.query_spec import raw_sql
    spark.range(3).createOrReplaceTempView("kept")
    out = raw_sql(spark, "SELECT max(k) AS m FROM {kept} WHERE k < :below", {"kept": spark.createDataFrame([(7,), (9,)], "k int")}, {"below": 9})
    assert out.first().m == 7 and spark.table("kept").count() == 3


def test_last_change_wins_and_own_values_are_no_duplicates(spark):
    state = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "pkid long, name string, num long")
    ch = spark.createDataFrame([(1, "edit", 1, "num", "9"), (2, "edit", 1, "num", "10"), (3, "edit", 2, "name", "c"), (4, "edit", 2, "name", "c"),
                                (5, "edit", 1, "name", "c")], "seq long, action string, pkid long, field string, value string")
    rules = [E.FieldRule("name", "varchar", 10, unique=True), E.FieldRule("num", "int", 3)]
    v = E.validate(ch, rules, state, "pkid")
    assert {r.seq: r.status for r in v.collect()} == {1: None, 2: None, 3: None, 4: None, 5: E.MSG_DUPLICATE}
    out = K.update(state, E.edits_to_changes(v, ["name", "num"], "pkid"), "pkid", ["name", "num"])
    assert sorted(map(tuple, out.collect())) == [(1, "a", 10), (2, "c", 6)]


def test_kernels_reduce_repeated_keys(spark):
    state = spark.createDataFrame([(1, "a", 1.0)], "k long, n string, v double")
    rows = spark.createDataFrame([(1, "x", None, 1), (1, None, 5.0, 2), (2, "y", 1.0, 3), (2, "z", None, 4)], "k long, n string, v double, s long")
    assert sorted(map(tuple, K.upsert(state, rows, "k", seq="s").collect())) == [(1, "x", 5.0), (2, "z", 1.0)]
    assert K.upsert(state, rows.drop("s"), "k").count() == 2
    ch = spark.createDataFrame([(1, "p", True, 1), (1, None, True, 2), (1, "q", False, 3)], "k long, n string, _set_n boolean, s long")
    assert [tuple(r) for r in K.update(state, ch, "k", ["n"], seq="s").collect()] == [(1, None, 1.0)]
    empty = state.limit(0)
    assert [r.k for r in K.append_with_keys(empty, spark.createDataFrame([("c", 1.0)], "n string, v double"), "k", ["n"]).collect()] == [1]


def test_form_changes(spark):
    pairs = [("action", "create"), ("data[7][main][name]", "x"), ("data[7][main][tags][]", "b"), ("data[7][main][tags][]", "a"), ("data[7][files][0][id]", "4"),
             ("data[7][files][1][id]", "2"), ("data[7][files-many-count]", "2"), ("data[3][main][name]", "first"), ("data[3][main][name]", "second"),
             ("data[3][list-many-count]", "0"), ("data[bad][x]", "1"), ("data[3]", "1"), ("other", "1")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "pos long, key string, value string").repartition(3)
    got = {(r.seq, r.action, r.pkid, r.field, r.value) for r in E.form_changes(df, upload_many={"files": "uploaded"}).collect()}
    assert got == {(1, "create", 7, "name", "x"), (1, "create", 7, "tags", "b,a"), (1, "create", 7, "uploaded", '[{"id":"4"},{"id":"2"}]'),
                   (7, "create", 3, "name", "second"), (7, "create", 3, "list-many-count", "0")}


def test_whole_edit_pipeline(spark):
    state = spark.createDataFrame([(4, "a", 1, None, "7"), (5, "b", 2, None, "7")], "pkid long, name string, fk_kind int, note string, scope string")
    kinds = spark.createDataFrame([(1, "old"), (2, "new")], "pkid long, label string")
    rules = [E.FieldRule("name", "varchar", 10, unique=True), E.FieldRule("fk_kind", "int"), E.FieldRule("note", "varchar", 20)]
    ch = spark.createDataFrame([(1, "create", 0, "name", "c"), (1, "create", 0, "fk_kind", "fresh"), (1, "create", 0, "note-many-count", "0"),
                                (2, "edit", 5, "fk_kind", "old"), (3, "create", 0, "name", "b"), (4, "edit", 4, "name", "late")],
                               "seq long, action string, pkid long, field string, value string")
    done = E.apply_edits(state, ch, rules, "pkid", tags={"kind": E.Tag(kinds, "label")}, scope=("scope", "9"))
    assert sorted(map(tuple, done.state.collect())) == [(4, "a", 1, None, "7"), (5, "b", 1, None, "7"), (6, "c", 3, "", "9")]
    assert {r.seq: r.valid for r in done.records.collect()} == {1: True, 2: True, 3: False, 4: True}
    assert [tuple(r) for r in done.created.collect()] == [(1, 6)]
    assert sorted(map(tuple, done.lookups["kind"].collect())) == [(1, "old"), (2, "new"), (3, "fresh")]
    every = E.apply_edits(state, ch, rules, "pkid", tags={"kind": E.Tag(kinds, "label")}, stop=False)
    assert sorted(r.name for r in every.state.collect()) == ["b", "c", "late"]


def test_references_and_guarded_delete(spark):
    hosts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "pkid long")
    lists = spark.createDataFrame([("1,3",), ("3,3",), (None,)], "fk_hosts_list string")
    ones = spark.createDataFrame([(2, 9), (2, 9)], "fk_hosts long, fk_hosts_other long")
    refs = E.reference_columns({"sets": lists, "ports": ones}, "hosts")
    assert [(n, c) for n, _, c in refs] == [("sets", "fk_hosts_list"), ("ports", "fk_hosts")]
    got = {(r.pkid, r.ref_table): r.n for r in E.dependency_counts(hosts, "pkid", refs).collect()}
    assert got == {(1, "sets"): 1, (3, "sets"): 2, (2, "ports"): 2}
    after, report = E.guarded_delete(hosts, hosts.where("pkid > 1"), "pkid", refs)
    assert sorted(r.pkid for r in after.collect()) == [1, 2, 3] and {r.pkid: r.deleted for r in report.collect()} == {2: False, 3: False, 4: True}
    assert E.guarded_delete(hosts, hosts, "pkid", [])[0].count() == 0


def test_seed_and_not_text(spark):
    rows = spark.createDataFrame([("Text File",), ("Counter CSV",)], "name string")
    first = E.seed(None, rows, "name", key="pkid")
    again = E.seed(first, rows, "name", key="pkid")
    assert sorted(map(tuple, again.collect())) == [(1, "Counter CSV"), (2, "Text File")]
    ch = spark.createDataFrame([(1, "edit", 1, "name", "5", "class 'int'"), (2, "edit", 2, "name", "5", "text"), (3, "edit", 2, "row_order", "5", "text")],
                               "seq long, action string, pkid long, field string, value string, kind string")
    v = {r.seq: (r.status, r.drop) for r in E.validate(ch, [E.FieldRule("name", "varchar", 9)], again, "pkid").collect()}
    assert v == {1: ("Required type varchar(string) but submitted as class 'int'", False), 2: (None, False), 3: (None, True)}


def test_reorder_only_when_every_record_is_a_row_id(spark):
    state = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "pkid long, row_order long")
    ch = spark.createDataFrame([(1, "edit", 1, "DT_RowId", "2"), (2, "edit", 2, "DT_RowId", "1")], "seq long, action string, pkid long, field string, value string")
    assert sorted(map(tuple, E.reorder_changes(state, ch, "pkid", "row_order").collect())) == [(1, 20), (2, 10), (3, 30)]
    mixed = ch.unionByName(spark.createDataFrame([(1, "edit", 1, "name", "x")], ch.schema))
    assert E.reorder_changes(state, mixed, "pkid", "row_order").orderBy("pkid").collect() == state.orderBy("pkid").collect()


def test_readers_always_find_a_version(spark):
    import tempfile
    root = tempfile.mkdtemp(prefix="hl-pub-")
    for i in range(12):
        K.publish(spark, spark.createDataFrame([(i,)], "k int"), root, "t")
    assert K.current(spark, root, "t").first().k == 11
