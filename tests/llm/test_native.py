import re

import pytest

from tracewell.llm import exact_dedup, mixing, queries, url_filter


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stages(spark, query):
    """Plans of a query and of everything that it stores on the way."""
    seen, patch = [], pytest.MonkeyPatch()
    for module in (exact_dedup, mixing, url_filter):
        settle = module.settle
        patch.setattr(module, "settle", lambda df, settle=settle: (seen.append(plan_of(df)), settle(df))[1])
    try:
        last = plan_of(query())
        return [*seen, last]
    finally:
        patch.undo()


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_source_mixing", "op6_license_scan", "op8_exact_dedup", "op12_personal_data"])
def test_native_operators_run_no_python(spark, sf_dir, name):
    for plan in stages(spark, lambda: queries.queries()[name](spark, sf_dir)):
        assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan


def test_url_filter_reads_two_columns(spark, sf_dir):
    plans = stages(spark, lambda: queries.op4_url_filter(spark, sf_dir))
    assert not any("html" in p for p in plans) and any("BroadcastHashJoin [block" in p for p in plans)
