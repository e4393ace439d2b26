"""Templates with several states against a line-by-line interpreter; the scan over functions against a loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hostlens.operators.function_scan import function_scan
from hostlens.plans.template import errors, extract, parse_template
from tests.conftest import small_slices


class Failed(Exception):
    pass


def interpret(template, lines):
    """One file, line by line."""
    t = parse_template(template)
    rules = {s: [r for r in t.rules if r.state == s] for s in t.states}
    cur, out, state = {v.name: None for v in t.values}, [], "Start"

    def clear(every=False):
        for v in t.values:
            if every or not v.filldown:
                cur[v.name] = None

    def record():
        if all(x is None for x in cur.values()):
            return
        if not any(v.required and not cur[v.name] for v in t.values):
            out.append(tuple(cur[v.name] or "" for v in t.values))
        clear()

    for n, line in enumerate(lines):
        if state in ("End", "EOF"):
            break
        for r in rules[state]:
            m = re.match(r.pattern.replace("(?<", "(?P<"), line)
            if not m:
                continue
            for name, g in r.groups.items():
                cur[name] = m.group(g) or ""
            if r.record_op == "Record":
                record()
            elif r.record_op != "NoRecord":
                clear(r.record_op == "Clearall")
            if r.target == "Error":
                raise Failed(n, line, r.message)
            if not r.goes_on:
                state = r.target or state
                break
    if state != "End" and not t.has_eof_state:
        record()
    return out


BASIC = r"""Value Filldown host (h\d)
Value Required metric (m\d)
Value val (\d+)

Start
  ^host ${host} -> Body
  ^seen ${val} -> Continue
  ^seen \d -> Record
  ^wipe -> Clearall

Body
  ^metric ${metric} -> Values
  ^host ${host} -> Continue.Clear
  ^host h\d
  ^back -> Start
  ^wipe -> Next.Clear Start

Values
  ^val ${val} -> Record
  ^val\w ${val} -> Next.Record Body
  ^host ${host} -> Record Body
  ^back -> Body
"""
ENDS = BASIC + "  ^wipe -> End\n"
STOPS = BASIC + "  ^wipe -> EOF\n"
NO_EOF = STOPS + "\nEOF\n"
FAILS = BASIC + '  ^wipe -> Error "odd wipe"\n'


def _lines(rng, n):
    kinds = ["host h{}", "metric m{}", "val {}", "valx {}", "seen {}", "back", "wipe", "noise"]
    return [rng.choices(kinds, [4, 5, 6, 2, 2, 1, 1, 3])[0].format(rng.randint(0, 9)) for _ in range(n)]


def _files(seed, hot=700):
    rng = random.Random(seed)
    files = {f"f{i}": _lines(rng, rng.randint(0, 50)) for i in range(14)}
    files["hot"] = _lines(rng, hot)
    return files


def _frame(spark, files):
    return spark.createDataFrame([(f, i, x) for f, ls in files.items() for i, x in enumerate(ls)], "file string, line_no long, line string")


@pytest.mark.parametrize("template", [BASIC, ENDS, STOPS, NO_EOF], ids=["basic", "end", "eof", "no-eof"])
def test_states_match_interpreter(spark, template):
    files = _files(3)
    df = _frame(spark, files)
    want = sorted((f, *r) for f, ls in files.items() for r in interpret(template, ls))
    assert len(want) > 20
    for size in (10_000, 40):       # few slices; the hot file in many slices
        with small_slices(spark, size):
            got = sorted((r.file, r.Host, r.Metric, r.Val) for r in extract(df, template).collect())
        assert got == want


def test_error_rules(spark):
    files = _files(5, hot=300)
    want, bad = [], []
    for f, ls in files.items():
        try:
            want += [(f, *r) for r in interpret(FAILS, ls)]
        except Failed as e:
            bad.append((f, *e.args))
    assert want and len(bad) > 2
    df = _frame(spark, files)
    with small_slices(spark, 40):
        assert sorted((r.file, r.Host, r.Metric, r.Val) for r in extract(df, FAILS).collect()) == sorted(want)
        assert sorted(map(tuple, errors(df, FAILS).collect())) == sorted(bad)
    none = errors(df, BASIC)
    assert none.count() == 0


def test_state_goes_on_across_files_if_asked(spark):
    df = _frame(spark, {"a": ["host h1", "metric m1"], "b": ["val 5", "back"], "c": ["metric m2", "val 7"]})
    got = [(r.file, r.Metric, r.Val) for r in extract(df, BASIC, carry_across_files=True).orderBy("file").collect()]
    assert got == [("b", "m1", "5"), ("c", "m2", "7")]
    assert extract(df, BASIC).where("Val != ''").count() == 0


@pytest.mark.parametrize("rule", ["^x -> Continue Body", "^x -> Nowhere", "^x -> Next.Oops", "^x -> Record.Next", "^x -> Next Record"])
def test_bad_actions(rule):
    with pytest.raises(ValueError):
        parse_template(f"Value v (x)\n\nStart\n  {rule}\n\nBody\n  ^x\n")


def test_bad_states():
    for body in ("Body\n  ^x\n", "Start\n  ^x\n\nStart\n  ^y\n", "Start\n  ^x\n\nEnd\n  ^y\n", "Start\n  ^x\n\nEOF\n  ^y\n"):
        with pytest.raises(ValueError):
            parse_template("Value v (x)\n\n" + body)


def test_function_scan_against_a_loop(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", "dd"]), i, [rng.randrange(5) if rng.random() < 0.3 else s for s in range(5)])
            for i in range(3000)]
    want, state = [], {}
    for k, i, step in rows:
        s = state.get(k, 2)
        state[k] = step[s]
        want.append((k, i, s, step[s]))
    df = spark.createDataFrame(rows, "k string, i long, step array<int>").repartition(7)
    for size in (10_000, 61):
        with small_slices(spark, size):
            got = function_scan(df, "k", ["i"], F.col("step"), states=5, start=2, before="was", after="is")
            assert got.columns == ["k", "i", "step", "was", "is"]
            assert sorted((r.i, r.k, r.was, r["is"]) for r in got.collect()) == [(i, k, b, a) for k, i, b, a in want]
    assert function_scan(df.limit(0), "k", ["i"], F.col("step"), states=5).count() == 0
