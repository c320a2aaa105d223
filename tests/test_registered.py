"""Registered queries against their SQL at the smallest scale; check.py runs all of them at any scale."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from callsight.plans.oracles import ORACLES
from callsight.plans.queries import QUERIES

QUICK = ["url_normalize", "link_extract", "endpoint_rollup", "schema_paths", "pacing_audit", "redirect_guard", "leak_scan", "diff_schema", "technologies"]


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"openapi_schemas", "openapi_paths"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees(spark, sf, name):
    good, note = check.compare(spark, check.connect(sf), sf, name)
    assert good, note


def test_entry(spark):
    assert entry(spark).count() > 0
