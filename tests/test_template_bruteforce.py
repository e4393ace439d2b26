"""Template extraction against a line-by-line interpreter on random inputs.

The interpreter below is a direct reading of the template semantics (first
matching rule, captures assigned, then Record / Clear / Clearall; Filldown
values survive Record and Clear; Required values gate a record; an all-empty
record is not emitted; pending values are emitted at end of input).
"""

import random
import re

from hostlens.plans.template import extract

TEMPLATE = """Value Filldown host (h\\d)
Value Required metric (m\\d)
Value val (\\d+)

Start
  ^host ${host}
  ^metric ${metric}
  ^val ${val} -> Record
  ^clear -> Clear
  ^wipe -> Clearall
  ^both ${metric} ${val} -> Record
"""

RULES = [(r"^host (h\d)", ["host"], None), (r"^metric (m\d)", ["metric"], None),
         (r"^val (\d+)", ["val"], "Record"), (r"^clear", [], "Clear"), (r"^wipe", [], "Clearall"),
         (r"^both (m\d) (\d+)", ["metric", "val"], "Record")]
NAMES = ["host", "metric", "val"]
FILLDOWN = {"host"}
REQUIRED = {"metric"}


def interpret(lines):
    cur = {n: None for n in NAMES}
    out = []

    def record():
        if all(cur[n] is None for n in NAMES):
            return
        if any(cur[n] is None for n in REQUIRED):
            clear()
            return
        out.append(tuple(cur[n] or "" for n in NAMES))
        clear()

    def clear():
        for n in NAMES:
            if n not in FILLDOWN:
                cur[n] = None

    for line in lines:
        for pat, names, op in RULES:
            m = re.match(pat, line)
            if m:
                for i, n in enumerate(names):
                    cur[n] = m.group(i + 1)
                if op == "Record":
                    record()
                elif op == "Clear":
                    clear()
                elif op == "Clearall":
                    for n in NAMES:
                        cur[n] = None
                break
    record()
    return out


def _random_file(rng, n):
    kinds = ["host h{}", "metric m{}", "val {}", "clear", "wipe", "both m{} {}", "noise {}"]
    weights = [2, 4, 5, 1, 1, 2, 2]
    return [rng.choices(kinds, weights)[0].format(rng.randint(0, 9), rng.randint(0, 99)) for _ in range(n)]


def test_random_templates_match_interpreter(spark):
    rng = random.Random(7)
    files = {f"f{i}": _random_file(rng, rng.randint(0, 60)) for i in range(12)}
    files["big"] = _random_file(rng, 900)          # one file far larger than the rest
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file string, line_no long, line string")
    expected = sorted((f, *rec) for f, lines in files.items() for rec in interpret(lines))
    from tests.conftest import small_slices
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, size in (("3", 10_000), ("37", 50)):     # few slices; many slices
            spark.conf.set("spark.sql.shuffle.partitions", n)
            with small_slices(spark, size):
                got = sorted((r.file, r.Host, r.Metric, r.Val) for r in extract(df, TEMPLATE).collect())
            assert got == expected, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
