"""The benchmark prints one line with seconds for every query that it names, and fails when it measures nothing."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import bench

ROOT = Path(__file__).resolve().parent.parent


def run(names: str) -> subprocess.CompletedProcess:
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_MEMORY": "2g", "BENCH_QUERIES": names}
    return subprocess.run([sys.executable, "bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)


def test_one_line_of_seconds():
    done = run("tasks_overdue,leak_folded")
    assert done.returncode == 0
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert line["queries"].keys() == {"tasks_overdue", "leak_folded"} and line["value"] > 0 and line["unit"] == "sec" and line["sf"] == "0.001"


def test_an_empty_run_fails():
    assert run("no_such_query").returncode == 1


def test_every_named_query_is_registered():
    from curalens.plans.catalogue import QUERIES

    assert set(bench.HEADLINE) <= QUERIES.keys()
