"""The JSON report as a query: records are parsed once, and raw rows are shuffled."""

from __future__ import annotations

import os
import re

import pytest

from lumenpick.operators import picking
from lumenpick.plans import catalogue
from lumenpick.plans import fixtures as f

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_records_are_parsed_once_and_raw_rows_are_shuffled(spark):
    plan = catalogue.report_json(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan
    below = plan[plan.index("Exchange"):]
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "AS photo_id" not in below and "struct(" not in below


@pytest.mark.parametrize("large", [1 << 20, 5])
def test_dealt_rows_rank_alike(spark, large):
    columns = ["photo_id", "cluster_id", "rank", "cluster_size", "winner", "final_score"]
    items, dealt = f.line_items(spark, SF_DIR), f.line_items(spark, SF_DIR, dealt=True)
    got = picking.ranked(items, large, dealt=dealt).select(columns)
    want = picking.ranked(items, large).select(columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_fields_at_paths(spark):
    rows = spark.createDataFrame([(1, '{"a": true, "b": {"c": 2, "d": {"e": 0.1}}, "f": "x\\n"}'), (2, '{"a": null, "b": null}'), (3, None)], "id long, record string")
    got = sorted(map(tuple, catalogue._json_fields(rows, ("a", "f"), ("b.c", "b.d.e")).collect()))  # noqa: SLF001
    assert got == [(1, "true", "x\n", 2.0, 0.1), (2, None, None, None, None), (3, None, None, None, None)]
