"""bench.py prints one JSON line with the driver's keys."""

import json
import os
import subprocess
import sys

from paths import ROOT, SF_SMALL


def test_bench_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="2",
               BENCH_QUERIES="qry_10,win_01")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    d = json.loads(lines[-1])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and "failed" not in d
    assert set(d["queries"]) == {"qry_10_monthly_revenue", "win_01_order_value_ntile"}
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-6
