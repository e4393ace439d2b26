"""Pages through a directory of slices, read-back by digests."""

from pyspark.sql import functions as F

from hostlens.operators.changes import read_back
from hostlens.operators.ordering import OrderedPages
from hostlens.session import scratch_path
from tests.conftest import SMALL


def test_any_page_reads_its_slices_alone(spark):
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    order = [F.col("o_orderstatus"), F.col("o_totalprice").desc()]
    pages = OrderedPages.store(o, order, "o_orderkey", scratch_path(spark, "ordered"), slices=12)
    want = [r.o_orderkey for r in o.orderBy(*order, "o_orderkey").collect()]
    for offset, size in ((0, 10), (777, 30), (len(want) - 5, 50), (len(want) + 5, 10), (100, 0), (0, len(want))):
        got = pages.page(offset, size)
        assert [(r.position, r.o_orderkey) for r in got.collect()] == list(enumerate(want))[offset:offset + size]
    plan = pages.page(777, 30)._jdf.queryExecution().executedPlan().toString()
    # the slices are told by the directory, so the scan takes their folders alone
    assert "PartitionFilters: [" in plan and "_slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert pages.page(5, 1).columns == [*o.columns, "position"]


def test_read_back_by_digests(spark):
    o = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    other = (o.where("o_orderkey % 97 != 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 101 == 2, F.lit(None)).otherwise(F.col("o_totalprice")))
             .unionByName(o.limit(1).withColumn("o_orderkey", F.lit(-5).cast("long"))))
    want = {(r.o_orderkey, f) for r in o.collect() for f in ("o_totalprice", "o_orderstatus", "o_orderdate")
            if r.o_orderkey % 97 == 1 or (r.o_orderkey % 101 == 2 and f == "o_totalprice")} | {(-5, f) for f in ("o_totalprice", "o_orderstatus", "o_orderdate")}
    for buckets in (1, 64, 4096):
        got = read_back(o, other, "o_orderkey", buckets=buckets)
        assert {(r.o_orderkey, r.field) for r in got.collect()} == want
    same = read_back(o, o.select(*reversed(o.columns)), "o_orderkey")
    assert same.count() == 0 and same.columns == got.columns == ["o_orderkey", "field", "requested", "stored"]
