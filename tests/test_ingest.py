"""Ingestion fixtures F1 (counter CSV) and F2 (device log + template)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from hostlens.functions.timefmt import normalize_time_text
from hostlens.plans.template import extract, parse_template
from hostlens.registered.ingest_q import CALLS_TEMPLATE
from hostlens.sources.counters import read_counters
from hostlens.sources.lines import read_lines


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_counter_csv_fixture(spark):
    d = tempfile.mkdtemp(prefix="hl-f1-")
    _write(d, "h1.csv",
           '"(PDH-CSV 4.0) (UTC)(0)","\\\\PROBE1\\Processor(_Total)\\% Processor Time","\\\\PROBE1\\Memory\\Quoted, Name"\n'
           '"12/08/2017 12:02:11.123","5.5","1"\n'
           '"12/08/2017 12:02:26.456"," ","2"\n'
           '"not a time","7","3"')                      # no newline at the end
    _write(d, "h2.csv",
           '"(PDH-CSV 4.0) (UTC)(0)","\\\\HOSTB\\Other\\% Processor Time","\\\\HOSTB\\Processor(_Total)\\% Processor Time"\n'
           '"12/08/2017 12:03:00.000","1","2"\n')
    _write(d, "h3.csv", '"(PDH-CSV 4.0) (UTC)(0)","\\\\HOSTC\\Memory\\Available Bytes"\n"12/08/2017 12:03:00.000","9"\n')
    rows, rejects = read_counters(spark, d, "Processor(_Total)\\% Processor Time")
    got = sorted((r.Hostname, r.time_text, r["Processor(_Total)\\% Processor Time"]) for r in rows.collect())
    assert got == [("HOSTB", "12/08/2017 12:03:00.000", 2.0),
                   ("PROBE1", "12/08/2017 12:02:11.123", 5.5),
                   ("PROBE1", "12/08/2017 12:02:26.456", None),
                   ("PROBE1", "not a time", 7.0)]
    assert [r.file.endswith("h3.csv") for r in rejects.collect()] == [True]
    norm = {r.t for r in rows.select(normalize_time_text("time_text").alias("t")).collect()}
    assert "12/08/2017 12:02:11" in norm and "not a time" in norm


LOG_A = """gate1#show calls
Query @ 09:34:33.123 UTC Fri May 11 2018
junk line that matches nothing
Total Number of Active Calls : 12
Query @ 09:34:48.123 UTC Fri May 11 2018
Query @ 09:34:49.123 UTC Fri May 11 2018
Total Number of Active Calls : 13
gate2>show calls
Total Number of Active Calls : 14
trailing line
"""


def test_template_fixture_per_file_and_eof(spark):
    d = tempfile.mkdtemp(prefix="hl-f2-")
    _write(d, "a.txt", "Total Number of Active Calls : 1\n" + LOG_A)      # Record before any host line
    _write(d, "empty.txt", "")
    lines = read_lines(spark, d)
    recs = extract(lines, CALLS_TEMPLATE).orderBy("record_no").collect()
    got = [(r.Timestamp, r.Hostname, r["Total Calls"]) for r in recs]
    assert got == [("", "", "1"),
                   ("09:34:33.123 UTC Fri May 11 2018", "gate1", "12"),
                   ("09:34:49.123 UTC Fri May 11 2018", "gate1", "13"),   # last capture wins
                   ("", "gate2", "14"),                                    # host change mid-file
                   ("", "gate2", "")]                                      # implicit record at end of input
    no_eof = extract(lines, CALLS_TEMPLATE + "\n\nEOF\n").count()
    assert no_eof == 4


def test_template_required_and_clear(spark):
    tpl = """Value Required name (\\w+)
Value count (\\d+)

Start
  ^name ${name}
  ^count ${count} -> Record
  ^reset -> Clear
"""
    df = spark.createDataFrame([("f", 0, "count 1"), ("f", 1, "name x"), ("f", 2, "reset"), ("f", 3, "count 2"),
                                ("f", 4, "name y"), ("f", 5, "count 3")], "file string, line_no long, line string")
    got = [(r.Name, r.Count) for r in extract(df, tpl).orderBy("record_no").collect()]
    assert got == [("y", "3")]


def _run(spark, template, lines, **kw):
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "file string, line_no long, line string")
    rows = extract(df, template, **kw).orderBy("record_no").collect()
    return [tuple(r)[2:] for r in rows]


def test_template_unsupported_forms():
    with pytest.raises(ValueError):      # a state that is not there
        parse_template("Value a (x)\n\nStart\n  ^${a} -> Record Other\n")
    with pytest.raises(NotImplementedError):
        parse_template("Value List,Filldown a (x)\n\nStart\n  ^${a} -> Record\n")


def test_template_end_anchor(spark):
    # $$ is the end of the line, not a dollar sign
    t = "Value a (\\w+)\n\nStart\n  ^A:${a}$$ -> Record\n\nEOF\n"
    assert _run(spark, t, ["A:x", "A:x y", "A:$", "A:z"]) == [("x",), ("z",)]


def test_template_empty_capture_overwrites(spark):
    t = "Value a (\\w*)\nValue b (\\d)\n\nStart\n  ^A:${a}$$\n  ^B:${b} -> Record\n\nEOF\n"
    assert _run(spark, t, ["A:x", "A:", "B:1", "A:y", "B:2", "B:3"]) == [("", "1"), ("y", "2"), ("", "3")]
    # an empty capture is a value: its record is not an all-empty one; a Required value must not be empty
    only = "Value a (\\w*)\n\nStart\n  ^A:${a}$$ -> Record\n\nEOF\n"
    assert _run(spark, only, ["A:", "A:x"]) == [("",), ("x",)]
    assert _run(spark, only.replace("Value a", "Value Required a"), ["A:", "A:x"]) == [("x",)]


def test_template_continue_and_list(spark):
    t = ("Value host (\\w+)\nValue List port (\\d+)\n\nStart\n  ^new -> Continue.Record\n  ^new ${host}\n"
         "  ^ports ${port} -> Continue\n  ^ports \\d+ ${port} -> Continue\n  ^port ${port}\n  ^drop -> Clear\n")
    lines = ["new a", "ports 1 2", "port 3", "new b", "noise", "new c", "port 9", "drop", "port 4"]
    assert _run(spark, t, lines) == [("a", ["1", "2", "3"]), ("b", []), ("", ["4"])]


def test_template_fillup(spark):
    t = "Value Fillup vlan (\\d+)\nValue port (p\\d)\n\nStart\n  ^vlan ${vlan}\n  ^port ${port} -> Record\n\nEOF\n"
    lines = ["port p1", "port p2", "vlan 7", "port p3", "port p4", "vlan 9", "port p5", "port p6"]
    assert _run(spark, t, lines) == [("7", "p1"), ("7", "p2"), ("7", "p3"), ("9", "p4"), ("9", "p5"), ("", "p6")]


def test_headings():
    from hostlens.functions.headings import heading
    assert heading("total_calls") == "Total Calls" and heading("CPU_load") == "CPU Load" and heading("MEM") == "MEM"
    assert heading("rx2tx_rate") == "Rx2Tx Rate" and heading("2G_cells") == "2G Cells" and heading("iOS_count") == "Ios Count"
    assert heading("a__b_") == "A  B " and heading("_x") == " X" and heading("") == ""
    assert heading("Total_calls", title=False) == "Total calls"


def test_carry_across_files(spark):
    df = spark.createDataFrame([("f1", 0, "gw1#x"), ("f2", 0, "Total Number of Active Calls : 5")],
                               "file string, line_no long, line string")
    per_file = [(r.Hostname, r["Total Calls"]) for r in extract(df, CALLS_TEMPLATE).collect()]
    carried = [(r.Hostname, r["Total Calls"]) for r in extract(df, CALLS_TEMPLATE, carry_across_files=True).collect()]
    assert sorted(per_file) == [("", "5"), ("gw1", "")]
    assert sorted(carried) == [("gw1", ""), ("gw1", "5")]


def test_template_clearall_resets_filldown(spark):
    tpl = """Value Filldown host (\\w+)
Value n (\\d+)

Start
  ^host ${host}
  ^n ${n} -> Record
  ^wipe -> Clearall
"""
    rows = [("f", i, l) for i, l in enumerate(["host a", "n 1", "n 2", "wipe", "n 3", "host b", "n 4"])]
    df = spark.createDataFrame(rows, "file string, line_no long, line string")
    got = [(r.Host, r.N) for r in extract(df, tpl).orderBy("record_no").collect()]
    assert got == [("a", "1"), ("a", "2"), ("", "3"), ("b", "4"), ("b", "")]
