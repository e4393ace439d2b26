"""Unique fields over a batch: against an interpreter that validates and applies record by record."""

import random

import pytest
from pyspark.sql import functions as F

from hostlens.operators import changes as E
from hostlens.operators import kernels as K
from tests.conftest import small_slices

CHANGES = "seq long, action string, pkid long, field string, value string"
RULES = [E.FieldRule("name", "varchar", 10, unique=True), E.FieldRule("code", "int", 4, unique=True), E.FieldRule("note", "varchar", 3)]


def interpret(state, records, stop):
    """(next table, seqs of duplicates with their field, applied seqs)."""
    table, dups, applied, top = {k: dict(v) for k, v in state.items()}, set(), [], max(state, default=0)
    for seq, action, pkid, fields in records:
        bad = False
        for f, v in fields.items():
            if f == "note" and len(v) > 3:
                bad = True
            if f in ("name", "code") and not (f == "code" and v == ""):
                others = [k for k, row in table.items() if row[f] is not None and str(row[f]) == v and (action == "create" or k != pkid)]
                if others:
                    bad = True
                    dups.add((seq, f))
        if bad and stop:
            return table, dups, applied
        if not bad:
            applied.append(seq)
            new = {f: (None if f == "code" and v == "" else int(v) if f == "code" else v) for f, v in fields.items()}
            if action == "create":
                top += 1
                table[top] = {"name": None, "code": None, "note": None, **new}
            elif pkid in table:
                table[pkid].update(new)
    return table, dups, applied


def _batch(rng, n, keys):
    out = []
    for seq in range(1, n + 1):
        action = rng.choice(["edit", "edit", "create"])
        fields = {}
        if rng.random() < 0.8:
            fields["name"] = rng.choice("ABCDEFGHIJKLMNOP")
        if rng.random() < 0.6:
            fields["code"] = str(rng.randrange(12)) if rng.random() < 0.85 or action == "create" else ""
        if rng.random() < 0.3 or not fields:
            fields["note"] = rng.choice(["ok", "okay"])
        out.append((seq * 10, action, rng.choice(keys), fields))
    return out


def _frames(spark, state, records):
    rows = spark.createDataFrame([(k, v["name"], v["code"], v["note"]) for k, v in state.items()], "pkid long, name string, code int, note string")
    changes = spark.createDataFrame([(s, a, p, f, v) for s, a, p, fs in records for f, v in fs.items()], CHANGES)
    return rows, changes.repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_against_interpreter(spark, seed):
    rng = random.Random(seed)
    state = {k: {"name": "ABCDEFGHIJ"[k - 1], "code": k, "note": "x"} for k in range(1, 9)}
    records = _batch(rng, 60, list(state))
    rows, changes = _frames(spark, state, records)
    spark.conf.set("hostlens.changes.smallTimeline", "0" if seed == 2 else "100000")     # in slices, or in windows
    with small_slices(spark, 20):
        got = E.apply_edits(rows, changes, RULES, "pkid", stop=False)
        table, dups, applied = interpret(state, records, stop=False)
        assert len(dups) > 10 and len(applied) > 10
        checked = E.validate(changes, RULES, rows, "pkid")
        assert {(r.seq, r.field) for r in checked.where(F.col("status") == E.MSG_DUPLICATE).collect()} == dups
        assert sorted(r.seq for r in got.records.collect() if r.valid) == sorted(applied)
        assert {r.pkid: {"name": r.name, "code": r.code, "note": r.note} for r in got.state.collect()} == table
    spark.conf.unset("hostlens.changes.smallTimeline")


def test_stops_at_the_first_bad_record(spark):
    rng = random.Random(9)
    state = {k: {"name": f"n{k}", "code": k + 100, "note": "x"} for k in range(1, 9)}
    records = [(10, "edit", 1, {"name": "free"}), (20, "edit", 2, {"name": "n1"}), (30, "create", 3, {"name": "n2", "code": "101"}),
               (40, "edit", 1, {"name": "x"})] + [(s + 100, *r) for s, *r in _batch(rng, 10, list(state))]
    rows, changes = _frames(spark, state, records)
    table, _, applied = interpret(state, records, stop=True)
    assert applied == [10, 20]       # the code of 30 is held by row 1 throughout
    got = E.apply_edits(rows, changes, RULES, "pkid", stop=True)
    assert {r.pkid: {"name": r.name, "code": r.code, "note": r.note} for r in got.state.collect()} == table


def test_value_freed_earlier_and_claim_of_a_rejected_record(spark):
    state = {5: {"name": "X", "code": 1, "note": "a"}, 7: {"name": "Z", "code": 2, "note": "a"}}
    records = [(1, "edit", 5, {"name": "Y"}), (2, "edit", 7, {"name": "X"})]
    rows, changes = _frames(spark, state, records)
    assert E.validate(changes, RULES, rows, "pkid").where("status is not null").count() == 0
    records = [(1, "create", 8, {"name": "N", "note": "too long"}), (2, "create", 9, {"name": "N"}), (3, "create", 10, {"name": "N"})]
    rows, changes = _frames(spark, state, records)
    bad = {(r.seq, r.field) for r in E.validate(changes, RULES, rows, "pkid").where("status is not null").collect()}
    assert bad == {(1, "note"), (3, "name")}


def test_chain_of_refused_records(spark):
    """A refusal that keeps a value held, which refuses the next, and so on: one round per link."""
    state = {k: {"name": f"n{k}", "code": None, "note": "a"} for k in range(1, 8)}
    records = [(1, "edit", 1, {"name": "new", "note": "too long"})] + [(k, "edit", k, {"name": f"n{k - 1}"}) for k in range(2, 8)]
    rows, changes = _frames(spark, state, records)
    checked = E.validate(changes, RULES, rows, "pkid")
    assert sorted(r.seq for r in checked.where(F.col("status") == E.MSG_DUPLICATE).collect()) == [2, 3, 4, 5, 6, 7]


def test_stored_types(spark):
    """Text that the stored type cannot hold is an error row; no cast ends the batch."""
    state = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "pkid long, num int, note string").withColumn("day", F.lit("2020-01-01").cast("date"))
    rules = [E.FieldRule("num", "int", 11), E.FieldRule("day", "date"), E.FieldRule("note", "varchar", 9)]
    rows = [(1, "edit", 1, "num", "99999999999"), (2, "edit", 2, "day", "someday"), (3, "edit", 2, "num", "7"), (4, "create", 9, "day", "2020-02-30"),
            (5, "create", 9, "day", "2021-02-28"), (6, "edit", 1, "day", ""), (7, "edit", 1, "num", "")]
    changes = spark.createDataFrame(rows, CHANGES)
    got = E.apply_edits(state, changes, rules, "pkid", stop=False)
    errors = {r.seq: [e.status for e in r.errors] for r in got.records.collect()}
    assert errors == {1: [E.MSG_NOT_STORED.format("int")], 2: [E.MSG_NOT_STORED.format("date")], 3: [], 4: [E.MSG_NOT_STORED.format("date")], 5: [], 6: [], 7: []}
    assert sorted((r.pkid, r.num, str(r.day)) for r in got.state.collect()) == [(1, None, "2020-01-01"), (2, 7, "2020-01-01"), (3, None, "2021-02-28")]


def test_update_kernel_keeps_what_it_cannot_store(spark):
    state = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k long, n int")
    ch = spark.createDataFrame([(1, "99999999999", True), (2, "8", True), (3, None, True)], "k long, n string, _set_n boolean")
    assert sorted(map(tuple, K.update(state, ch, "k", ["n"]).collect())) == [(1, 5), (2, 8), (3, None)]
    assert [tuple(r) for r in K.unfit(state, ch, "k", ["n"]).collect()] == [(1, "n", "99999999999")]
