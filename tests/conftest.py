import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hostlens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s


SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


class small_slices:
    """Force many scan slices on small test data (one slice per ``rows`` rows)."""

    def __init__(self, spark, rows=100):
        self.spark, self.rows = spark, rows

    def __enter__(self):
        self.old = self.spark.conf.get("hostlens.scan.sliceRows", None)
        self.spark.conf.set("hostlens.scan.sliceRows", str(self.rows))
        return self

    def __exit__(self, *exc):
        if self.old is None:
            self.spark.conf.unset("hostlens.scan.sliceRows")
        else:
            self.spark.conf.set("hostlens.scan.sliceRows", self.old)
