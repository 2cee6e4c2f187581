"""Run automata against one event after the other."""

from __future__ import annotations

import random

import duckdb
import pytest

from curalens.plans import catalogue
from curalens.streaming import automata

ALLOWED = {(step, state): after for step, state, after in automata.TRANSITIONS}
STEPS = [*dict.fromkeys(s for s, _, _ in automata.TRANSITIONS), "unknown", None]


def one_by_one(log):
    """The steps and the records of a log of (run, order, step)."""
    rows, held = [], {}
    for run, order, step in sorted({x for x in log if x[0] is not None and x[1] is not None}, key=lambda x: (x[0], x[1], x[2] or "")):
        state, resumed, stopped, illegal = held.get(run, ("absent", 0, 0, 0))
        after = ALLOWED.get((step, state))
        resumed, stopped, illegal = resumed + (after is not None and step == "resume"), stopped + (after is not None and step == "interrupt"), illegal + (after is None)
        rows.append((run, order, step, state, after or state, after is not None, resumed, stopped))
        held[run] = (after or state, resumed, stopped, illegal)
    return rows, {(r, *v) for r, v in held.items()}


@pytest.mark.parametrize(("block", "fan"), [(512, 512), (3, 2)])
def test_steps_and_records_against_one_by_one(spark, block, fan):
    rng = random.Random(4)
    log = [(1, 0, "reserve"), (1, 1, "spawn"), (1, 1, "spawn"), (None, 3, "reserve"), (2, None, "reserve"), (9, -7, "reserve")]
    for k in range(2, 160):  # one run has most of the events
        log.append((1 if rng.random() < 0.6 else rng.randrange(2, 7), k * 2, rng.choice(STEPS if rng.random() < 0.5 else STEPS[:6])))
    events = spark.createDataFrame(log, "user long, at long, step string")
    rows, held = one_by_one(log)
    got = [tuple(r) for r in automata.run_steps(events, "user", "at", "step", block, fan).collect()]
    assert sorted(got, key=lambda r: r[:2]) == rows
    assert {tuple(r) for r in automata.run_records(events, "user", "at", "step", block, fan).collect()} == held


def test_an_empty_log(spark):
    events = spark.createDataFrame([], "user long, at long, step string")
    assert automata.run_steps(events, "user", "at", "step").collect() == automata.run_records(events, "user", "at", "step").collect() == []


def test_every_state_is_reached_and_terminal(spark):
    paths = ["reserve", "reserve spawn", "reserve spawn_fail poll spawn", "reserve spawn poll", "reserve spawn interrupt", "reserve spawn fail", "reserve spawn poll interrupt resume finish resume interrupt reserve poll"]
    log = [(k, i, step) for k, path in enumerate(paths) for i, step in enumerate(path.split())]
    got = {r["user"]: r for r in automata.run_records(spark.createDataFrame(log, "user long, at long, step string"), "user", "at", "step").collect()}
    assert [got[k]["state"] for k in range(len(paths))] == [s for s in automata.STATES if s != "absent"]
    assert (got[6]["resume_count"], got[6]["interruptions"], got[6]["illegal"], got[2]["illegal"]) == (1, 1, 3, 1)


def test_runs_of_clicks(spark):
    sf = "/root/testdata/sf0.01"
    log = duckdb.sql(f"SELECT client_id, click_id, {catalogue.CLICKED} FROM '{sf}/clicks.parquet'").fetchall()
    got = {tuple(r) for r in catalogue.QUERIES["click_runs"](spark, sf).collect()}
    assert got == one_by_one(log)[1] and len(got) > 100
    assert len({r[1] for r in got}) > 3
