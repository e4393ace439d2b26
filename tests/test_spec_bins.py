"""Many saved specs: joined by bins of time, with the results of the broadcast."""

import json
import random

from pyspark.sql import functions as F

from hostlens.operators.specs import run_specs
from tests.conftest import SMALL


def _frame(spark):
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    return ev.select(F.col("event_id").alias("pos"), F.col("ts").alias("Timestamp"), F.col("user_id").cast("string").alias("Hostname"),
                     F.col("event_type").alias("Series"), F.col("value").alias("Value"))


def test_bins_give_what_the_broadcast_gives(spark):
    df = _frame(spark)
    rng = random.Random(2)
    specs = []
    for i in range(60):
        day, hour = rng.randrange(1, 28), rng.randrange(24)
        o = {"hostnames": rng.choice(["", "3", ["1", "2", "5"]]), "filter": rng.choice(["", "click"]), "interval": rng.choice(["", "30", "3600"]),
             "aggregation": rng.choice(["", "last", "mean"]), "bucket": rng.choice(["position", "time"])}
        span = rng.choice([0, 1, 40, 500, 3000, None])     # hours; none: an open range
        if span is not None:
            o |= {"start_time": f"2024-01-{day:02d} {hour:02d}:00:00", "end_time": str(_plus(day, hour, span))}
        elif rng.random() < 0.5:
            o["start_time"] = f"2024-01-{day:02d} {hour:02d}:30:00"
        specs.append((i, json.dumps(o)))
    specs.append((100, json.dumps({"start_time": "2024-01-05 00:00:00", "end_time": "2024-01-04 00:00:00"})))      # no time at all
    table = spark.createDataFrame(specs, "spec_id long, options string")
    want = run_specs(df, table)
    got = run_specs(df, table, max_specs=0)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.spec_id, r.host if "host" in r else r.Hostname, -1 if r.bucket is None else r.bucket, str(r.Timestamp), round(r.Value or 0, 6))
    a, b = sorted(map(key, got.collect())), sorted(map(key, want.collect()))
    assert a == b and len({r[0] for r in a}) > 40


def _plus(day, hour, span):
    from datetime import datetime, timedelta
    return datetime(2024, 1, day, hour) + timedelta(hours=span)


def test_narrow_specs_cost_their_overlaps(spark):
    """Thousands of specs of one hour: rows made by the join follow the overlaps, not specs times rows."""
    df = _frame(spark)
    specs = spark.range(3000).select(F.col("id").alias("spec_id"), F.to_json(F.struct(
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900), "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900 + 3600), "yyyy-MM-dd HH:mm:ss").alias("end_time"))).alias("options"))
    got = run_specs(df, specs, max_specs=100)
    at = F.unix_seconds(F.col("Timestamp").cast("timestamp")) - 1704067200
    inside = df.select(F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(at / 900) - k), lambda b: (b >= 0) & (b < 3000) & (
        F.col("Timestamp") <= F.timestamp_seconds(F.lit(1704067200) + b * 900 + 3600).cast("timestamp_ntz")))))
    assert got.count() == inside.count() > 100
