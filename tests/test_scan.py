"""keyed_scan / ordinal against plain windows, under skew and partition counts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.operators.scan import keyed_scan, ordinal, slice_count, sliced
from tests.conftest import SF


def _skewed(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    host = (F.when(F.col("event_type") == "click", F.lit(None).cast("string"))
            .when(F.col("event_type").isin("view", "error"), F.lit("hot"))   # ~40% of rows on one key
            .otherwise(F.col("user_id").cast("string")))
    return ev.withColumn("host", host).withColumn("cap", F.when(F.col("value") > 40, F.col("value")))


def test_keyed_scan_matches_window_under_skew(spark):
    ev = _skewed(spark)
    w = W.partitionBy("host").orderBy("ts", "event_id")
    ref = (ev.withColumn("rn", F.row_number().over(w).cast("long"))
           .withColumn("big", F.sum((F.col("value") > 30).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("ff", F.last("cap", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
           .select("event_id", "rn", "big", "ff"))
    for n in (1, 16, 1000):
        out = keyed_scan(ev, "host", ["ts", "event_id"], sums={"rn": F.lit(1), "big": F.col("value") > 30},
                         fills={"ff": "cap"}, partitions=n).select("event_id", "rn", "big", "ff")
        assert out.exceptAll(ref).count() == 0 and ref.exceptAll(out).count() == 0, n


def test_frame_ordinal_is_dense(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    out = ordinal(ev, None, ["event_id"], name="rn", partitions=16)
    row = out.agg(F.min("rn"), F.max("rn"), F.count("*"), F.sum(F.col("rn") - F.col("event_id"))).first()
    assert row[0] == 0 and row[1] == row[2] - 1 and row[3] == 0   # event_id is 0..n-1


def test_scan_places_rows_by_slice_and_broadcasts_nothing(spark):
    ev = _skewed(spark)
    out = keyed_scan(ev, "host", ["ts", "event_id"], sums={"rn": F.lit(1)}, partitions=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" not in plan
    # the rows move once after the slices are written: by slice number, which the window keeps
    main = plan[:plan.index("Union")] if "Union" in plan else plan
    assert main.count("Exchange") == 1


def test_slices_are_even_after_a_join(spark):
    """A join before the scan misleads size estimates; slices follow the counted rows."""
    ev = _skewed(spark)
    joined = ev.join(spark.range(5).withColumnRenamed("id", "copy"), F.lit(True)).withColumn("big", F.concat(F.lit("x" * 50), F.col("event_id")))
    from tests.conftest import small_slices
    with small_slices(spark, 2000):
        n = slice_count(joined)
        cut = sliced(joined.withColumn("k", F.col("host")).withColumn("o", F.struct("ts", "event_id", "copy")), ["k", "o"], n)
        sizes = [r[1] for r in cut.groupBy("_scan_part").count().collect()]
    rows = joined.count()
    assert n >= rows // 2000 and len(sizes) > 0.8 * n and max(sizes) < 4 * rows / n


def test_long_text_keys(spark):
    """Bounds hold prefixes only; texts with a common prefix of any length are still told apart."""
    stem = "p" * 300
    rows = [(i, stem[:250 + i % 60] + str(i % 7), i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, o long")
    w = W.partitionBy("k").orderBy("o", "id")
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w) - 1).collect()}
    for n in (1, 16, 1000):
        assert {r.id: r.rn for r in ordinal(df, "k", ["o", "id"], partitions=n).collect()} == want
    whole = [r.id for r in df.orderBy("k", "o", "id").collect()]
    got = [r.id for r in ordinal(df, None, ["k", "o", "id"], partitions=16).orderBy("rn").collect()]
    assert got == whole


def test_marks_and_values_before_a_row(spark):
    rows = [(f"h{i % 3}", i, i if i % 4 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "h string, o long, v long")
    w = W.partitionBy("h").orderBy("o")
    want = {(r.h, r.o): (r.b, r.last) for r in df.withColumn("b", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
            .withColumn("last", F.lead("o").over(w).isNull()).collect()}
    for n in (1, 5, 60):
        out = keyed_scan(df, "h", ["o"], befores={"b": "v"}, mark_last="last", partitions=n)
        assert out.columns == ["h", "o", "v", "b", "last"]
        assert {(r.h, r.o): (r.b, r.last) for r in out.collect()} == want
    assert keyed_scan(df.limit(0), "h", ["o"], sums={"s": F.lit(1)}).count() == 0


def test_ordinals_move_no_row_after_the_slices(spark, monkeypatch):
    """Positions are arithmetic over the written slices; many (slice, key) pairs are joined instead of broadcast."""
    from hostlens.operators import scan
    ev = _skewed(spark)
    w = W.partitionBy("host")
    ref = ev.select("event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("rn"), F.count("*").over(w).alias("of"))
    for most in (scan.BROADCAST_STARTS, 0):
        monkeypatch.setattr(scan, "BROADCAST_STARTS", most)
        out = ordinal(ev, "host", ["ts", "event_id"], partitions=16, total="of")
        assert set(out.columns) == {*ev.columns, "rn", "of"}
        if most:
            rows = out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
            assert "Exchange" not in rows
        got = out.select("event_id", "rn", "of")
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_a_dear_input_is_computed_once(spark):
    """An input with a join is written once; a plain scan is not."""
    from hostlens.operators.scan import computed_once
    ev = _skewed(spark)
    assert computed_once(ev) is ev
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    made = ev.select("event_id", "host").mapInArrow(count, "event_id long, host string")
    out = ordinal(made, "host", ["event_id"])
    n = ev.count()
    assert out.count() == n and out.agg(F.max("rn")).first()[0] > 0
    assert seen.value == n


def test_first_and_last_of_buckets_by_position(spark):
    from hostlens.operators.series import positional_buckets
    ev = _skewed(spark).select(F.col("host").alias("Hostname"), F.col("ts").alias("Timestamp"), F.col("event_id").alias("pos"), F.col("value").alias("Value"))
    w = W.partitionBy("Hostname").orderBy("Timestamp", "pos")
    ranked = ev.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / 3).cast("bigint"))
    at = F.struct("Timestamp", "pos")
    for agg, pick in (("last", F.max_by), ("first", F.min_by)):
        want = ranked.groupBy("Hostname", "bucket").agg(pick(F.struct("Timestamp", "pos", "Value"), at).alias("r")).select("Hostname", "bucket", "r.*")
        got = positional_buckets(ev, 45, agg)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
