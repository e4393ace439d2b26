"""Series operators on hand-worked fixtures (F3) and invariants."""

import datetime as dt

from pyspark.sql import functions as F

from hostlens.operators import series as S
from hostlens.operators.profile import host_profile
from hostlens.registered.common import measurements
from tests.conftest import SF

T0 = dt.datetime(2018, 5, 11, 9, 0, 0)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "Timestamp timestamp_ntz, Hostname string, Series string, Value string, pos long")


def _f3(spark):
    rows = []
    for i in range(7):   # host a: 7 rows, one non-numeric value, a tie on time at rows 2 and 3
        t = T0 + dt.timedelta(seconds=15 * (i if i != 3 else 2))
        rows.append((t, "a", "x" if i < 4 else "y", "bad" if i == 5 else f" {i}.5 ", i))
    rows.append((T0, "b", "x", "7", 100))          # host b: fewer rows than one bucket
    return _frame(spark, rows)


def test_bucket_rows_rule():
    assert S.bucket_rows(30) == 2 and S.bucket_rows("45") == 3
    assert S.bucket_rows(15) == 0 and S.bucket_rows(20) == 0 and S.bucket_rows(0) == 0 and S.bucket_rows("x") == 0


def test_coercion_and_host_filter(spark):
    df = S.coerce_numeric(_f3(spark), "Value")
    vals = {r.pos: r.Value for r in df.collect()}
    assert vals[0] == 0.5 and vals[5] is None and vals[100] == 7.0
    assert S.select_hosts(df, ["b"]).count() == 1
    assert S.select_hosts(df, []).count() == 8 and S.select_hosts(df, "a").count() == 7


def test_positional_last_keeps_nulls_and_first(spark):
    df = S.coerce_numeric(_f3(spark), "Value")
    last = {(r.Hostname, r.bucket): r for r in S.positional_buckets(df, 30, "last").collect()}
    # host a buckets: [0,1], [2,3], [4,5], [6]; the tie at 2/3 is ordered by pos
    assert last[("a", 2)].pos == 5 and last[("a", 2)].Value is None      # null of the last row kept
    assert last[("a", 3)].pos == 6 and last[("b", 0)].pos == 100
    first = {(r.Hostname, r.bucket): r.pos for r in S.positional_buckets(df, 30, "first").collect()}
    assert first == {("a", 0): 0, ("a", 1): 2, ("a", 2): 4, ("a", 3): 6, ("b", 0): 100}


def test_min_max_columns_independent_and_mean(spark):
    df = S.coerce_numeric(_f3(spark), "Value")
    mx = {(r.Hostname, r.bucket): r for r in S.positional_buckets(df, 45, "max").collect()}
    assert mx[("a", 1)].Value == 4.5 and mx[("a", 1)].pos == 5           # value and pos from different rows
    mean = {(r.Hostname, r.bucket): r for r in S.positional_buckets(df, 45, "mean").collect()}
    assert abs(mean[("a", 1)].Value - 4.0) < 1e-9 and mean[("a", 1)].Timestamp == T0 + dt.timedelta(seconds=30)


def test_unknown_aggregation_and_bad_interval_pass_through(spark):
    df = _f3(spark)
    assert S.positional_buckets(df, 30, "median").columns == df.columns
    assert S.positional_buckets(df, 20, "last").count() == 8


def test_time_range_closed(spark):
    df = _f3(spark)
    out = S.time_range(df, "Timestamp", "2018-05-11 09:00:15", "2018-05-11 09:00:30")
    assert sorted(r.pos for r in out.collect()) == [1, 2, 3]


def test_bucket_counts_sum_to_rows(spark):
    df = S.coerce_numeric(measurements(spark, SF), "Value")
    stats = S.time_bucket_stats(df, 3600)
    assert stats.agg(F.sum("n")).first()[0] == df.count()
    bad = stats.where((F.col("min_value") > F.col("mean_value") + 1e-9) | (F.col("mean_value") > F.col("max_value") + 1e-9))
    assert bad.count() == 0
    prof = host_profile(df)
    assert prof.agg(F.sum("n_rows")).first()[0] == df.count()


def test_hour_ticks_thinning(spark):
    df = _frame(spark, [(T0, "a", "x", "1", 0), (T0 + dt.timedelta(hours=10, minutes=5), "a", "x", "2", 1)])
    ticks = [r.tick_hour for r in S.hour_ticks(df, max_labels=4).orderBy("tick_hour").collect()]
    assert ticks == [0, 3, 6, 9]                    # at most four labels


def test_pivot_and_ordinal(spark):
    df = S.coerce_numeric(_f3(spark), "Value")
    p = S.pivot_wide(df, "Hostname", "Series", ["x", "y"], "Value", agg="count").orderBy("row_key").collect()
    assert [(r.row_key, r.x, r.y) for r in p] == [("a", 4, 2), ("b", 1, None)]   # count skips the null value
    xs = S.ordinal_x(df, "Hostname", ["Timestamp", "pos"]).where("Hostname = 'a'").orderBy("pos").collect()
    assert [r.x for r in xs] == list(range(7))


def test_same_answer_under_partition_counts(spark):
    from hostlens.registry import all_queries
    qs = all_queries()
    from tests.conftest import small_slices
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            with small_slices(spark, 100):
                df = qs["q8a_last_30"].build(spark, SF)
                results.append(sorted(map(tuple, df.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_natural_rank_keeps_rows(spark):
    from hostlens.operators.ordering import natural_rank
    p = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    r = natural_rank(p, "url", "page_id")
    row = r.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
    assert row[0] == p.count() == row[1] and row[2] == 0 and row[3] == row[0] - 1


def test_hour_ticks_never_exceed_the_limit(spark):
    for hours in (0, 1, 9, 23, 24, 25, 239):
        df = _frame(spark, [(T0, "a", "x", "1", 0), (T0 + dt.timedelta(hours=hours), "a", "x", "2", 1)])
        for most in (1, 7, 10, 24):
            ticks = [r.tick_hour for r in S.hour_ticks(df, max_labels=most).collect()]
            assert 0 in ticks and len(ticks) <= most
    assert S.hour_ticks(df).count() == 240


def test_pivot_first_is_by_position(spark):
    df = _frame(spark, [(T0, "a", "x", "late", 9), (T0, "a", "x", "early", 2), (T0, "a", "y", "only", 5), (T0, "b", "y", "q", 1)])
    wide = {r.row_key: (r.x, r.y) for r in S.pivot_wide(df.repartition(3), "Hostname", "Series", ["x", "y"], "Value").collect()}
    assert wide == {"a": ("early", "only"), "b": (None, "q")}
    left = S.pivot_left(df, "Hostname", "Series", ["x", "y"], "Value").collect()
    assert [(r.row_key, r.x, r.y) for r in left] == [("a", "early", "only")]
    assert S.pivot_values(df, "Series") == ["x", "y"]


def test_saved_specs_options(spark):
    from hostlens.operators.specs import run_specs
    df = S.coerce_numeric(_f3(spark), "Value")
    specs = spark.createDataFrame([(0, "{}"), (1, '{"hostnames": ["b"]}'), (2, "not json"), (3, '{"interval": "30", "aggregation": "last"}'),
                                   (4, '{"filter": "y", "interval": 0, "aggregation": "mean", "bucket": "time"}'), (5, None),
                                   (6, '{"hostnames": "a", "start_time": "2018-05-11 09:00:15", "end_time": "2018-05-11 09:00:30"}'),
                                   (7, '{"selected": "Hostname", "filter": "b", "plot": "pos"}')], "spec_id int, options string")
    out = {}
    for r in run_specs(df, specs, columns=["Hostname", "pos"]).collect():
        out.setdefault(r.spec_id, []).append((r.Hostname, r.bucket, r.Value))
    assert [len(out[i]) for i in (0, 1, 2, 4, 5, 6, 7)] == [8, 1, 8, 3, 8, 3, 1]
    assert sorted(out[3], key=str) == [("a", 0, 1.5), ("a", 1, 3.5), ("a", 2, None), ("a", 3, 6.5), ("b", 0, 7.0)]
    assert out[7] == [("b", None, 100.0)]


def test_time_texts(spark):
    from hostlens.functions.timefmt import parse_time, time_losses
    df = spark.createDataFrame([("09:34:33.123 UTC Fri May 11 2018",), ("*9:34:33 UTC Tue May 1 2018",), ("2018-05-11 09:34:33",), ("soon",), ("",), (None,)], "t string")
    got = [r.p for r in df.select(parse_time("t").alias("p")).collect()]
    assert got[:3] == [dt.datetime(2018, 5, 11, 9, 34, 33), dt.datetime(2018, 5, 1, 9, 34, 33), dt.datetime(2018, 5, 11, 9, 34, 33)] and got[3:] == [None] * 3
    assert tuple(time_losses(df, "t").first()) == (6, 1, "soon")
