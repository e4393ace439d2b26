"""Counter CSVs with short lines, quoted line breaks and stray quotes, against pandas."""

import csv
import io
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from hostlens.sources.counters import csv_cells, csv_records, read_counters
from tests.conftest import small_slices

COUNTER = "Load"


def test_cells(spark):
    lines = ['a,b', ',b,', '"x, y",2', '"say ""hi""",3', '', '"a"b,c', '"two\nlines",z', 'in"side,1', '" "," "']
    got = [r.c for r in spark.createDataFrame([(x,) for x in lines], "line string").select(csv_cells(F.col("line")).alias("c")).collect()]
    assert got == [["a", "b"], ["", "b", ""], ["x, y", "2"], ['say "hi"', "3"], [""], ["ab", "c"], ["two\nlines", "z"], ['in"side', "1"], [" ", " "]]


def _random_csv(rng, n):
    """Text of a CSV with quoted breaks, stray quotes and short records, and its records by Python's reader."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for _ in range(n):
        cells = ["".join(rng.choices(['a', 'b', '"', ',', '\n', ' '], [6, 4, 1, 1, 1, 1], k=rng.randrange(6))) for _ in range(rng.randrange(1, 5))]
        cells[0] = "k" + cells[0]       # no blank lines
        w.writerow(cells)
        if rng.random() < 0.1:
            out.write('k5" pipe,"two\n\nbreaks"\n')
    return out.getvalue()


def test_records_against_a_csv_reader(spark):
    rng = random.Random(4)
    files = {f"f{i}": _random_csv(rng, rng.randrange(1, 30)) for i in range(6)} | {"hot": _random_csv(rng, 400), "open": 'a,b\n"never\nclosed'}
    rows = [(f, 0, i, line) for f, t in files.items() for i, line in enumerate(t.split("\n")[:-1] if t.endswith("\n") else t.split("\n"))]
    df = spark.createDataFrame(rows, "file string, _block long, _mid long, line string").repartition(5)
    want = {f: list(csv.reader(io.StringIO(t))) for f, t in files.items()}
    want["open"] = [["a", "b"], ['"never\nclosed']]      # an open cell is kept as it stands
    with small_slices(spark, 60):
        got = {}
        for r in csv_records(df).select("file", "_mid", csv_cells(F.col("line")).alias("c")).orderBy("file", "_mid").collect():
            got.setdefault(r.file, []).append(r.c)
    assert got == want


def _file(d, name, text):
    with open(os.path.join(d, name), "w") as f:
        f.write(text)


def test_short_lines_and_quoted_breaks(spark):
    d = tempfile.mkdtemp(prefix="hl-i1-")
    head = '"(PDH)","\\\\{}\\Load","\\\\{}\\Note"\n'
    _file(d, "cut.csv", head.format("CUT", "CUT") + '"01/01/2024 00:00:01",1,x\n"01/01/2024 00:00:02"\n,3\n"01/01/2024 00:00:04",4\n"01/01/20')
    _file(d, "breaks.csv", head.format("BRK", "BRK").replace("Note", "No\nte") + '"01/01/2024 00:00:01",1,"one\ntwo, ""3""\n"\n"01/01/2024 00:00:02",2,"z"\n')
    _file(d, "one.csv", "single\n1\n2\n")
    _file(d, "blank.csv", "\n\n")
    rows, rejects = read_counters(spark, d, COUNTER)
    got = sorted(((r.Hostname, r.time_text, r.Load) for r in rows.collect()), key=repr)
    # the cell that is never closed is kept as it stands
    assert got == sorted([("CUT", "01/01/2024 00:00:01", 1.0), ("CUT", "01/01/2024 00:00:02", None), ("CUT", "", 3.0), ("CUT", "01/01/2024 00:00:04", 4.0),
                          ("CUT", '"01/01/20', None), ("BRK", "01/01/2024 00:00:01", 1.0), ("BRK", "01/01/2024 00:00:02", 2.0)], key=repr)
    assert sorted((os.path.basename(r.file), r.reason) for r in rejects.collect()) == [
        ("blank.csv", "counter not found: Load"), ("one.csv", "counter not found: Load")]
    frame = pd.read_csv(os.path.join(d, "breaks.csv"))
    assert [r[2] for r in got if r[0] == "BRK"] == frame[frame.columns[1]].tolist()


def test_one_file_over_many_splits(spark):
    """A file of many read splits, with quoted cells that cross them."""
    d = tempfile.mkdtemp(prefix="hl-i1-")
    rng = random.Random(2)
    body = "".join(f'"01/01/2024 00:{i // 60 % 60:02d}:{i % 60:02d}",{i},"{"note " * rng.randrange(3)}{chr(10) * rng.randrange(3)}end"\n' for i in range(3000))
    _file(d, "big.csv", '"(PDH)","\\\\BIG\\Load","\\\\BIG\\Note"\n' + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        with small_slices(spark, 700):
            rows, rejects = read_counters(spark, d, COUNTER)
            assert sorted(r.Load for r in rows.collect()) == list(range(3000)) and rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
