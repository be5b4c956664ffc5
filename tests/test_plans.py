"""Physical-plan checks for scale: pruning reaches the scan, no row-at-a-time
Python, and the global NTILE needs neither a window nor one partition for its
rows."""

import re

import pytest

from revlens.catalog import REGISTRY
from revlens.plans import sql_analyses as q

from paths import SF_CHECK


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_monthly_revenue_prunes_columns(small_tables):
    plan = q.qry_10_monthly_revenue(small_tables)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas, plan
    for s in schemas:
        cols = {c.split(":")[0] for c in s.split(",")}
        assert cols <= {"o_orderkey", "o_orderstatus", "o_orderdate", "l_orderkey",
                        "l_extendedprice", "c_custkey", "c_nationkey", "n_nationkey"}, s


@pytest.mark.parametrize("name", [n for n in sorted(REGISTRY) if n.startswith(("qry_", "ana_"))])
def test_no_row_at_a_time_python(small_tables, name):
    plan = _plan(REGISTRY[name](small_tables))
    assert "BatchEvalPython" not in plan


def test_global_ntile_needs_no_window_over_all_rows(spark, small_tables, multi_bucket):
    df = q.rfm_scores(small_tables)
    plan = _plan(df)
    assert "Window" not in plan and "rangepartitioning" not in plan
    assert all(_PARTIAL.match(node) for node in _single_partition_inputs(plan))
    assert df.count() > 0


#: A row, or k rows, for each task.
_PARTIAL = re.compile(r"(HashAggregate|ObjectHashAggregate|SortAggregate)\(keys=\[\], functions=\[(\]|.*partial_)"
                      r"|LocalLimit|TakeOrderedAndProject")


def _single_partition_inputs(plan: str) -> list[str]:
    """The node under each ``Exchange SinglePartition``."""
    lines = plan.splitlines()
    return [re.sub(r"^[\s:+\-*()0-9]*", "", lines[i + 1]) for i, line in enumerate(lines)
            if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_single_partition_over_data(spark, name):
    """With default settings only partial aggregates and limits (a row or k
    rows for each task) are gathered into one partition."""
    from revlens.sources.adapters import load_tables
    plan = _plan(REGISTRY[name](load_tables(spark, SF_CHECK)))
    for node in _single_partition_inputs(plan):
        assert _PARTIAL.match(node), node


def test_python_only_where_city_text_is_needed(small_tables):
    # title case decides which sellers the cleaning drops, so analyses that
    # join sellers run it; NFKD only shapes the city that is output
    assert "_nfkd(" in _plan(REGISTRY["cln_03_sellers"](small_tables))
    plan = _plan(REGISTRY["ana_06_distance_bins"](small_tables))
    assert "_nfkd(" not in plan and "BatchEvalPython" not in plan
