"""Every registered query against its SQL, on the same tables."""

import re

import oracle
import pytest
from conftest import ORACLE, SMALL

import __spark_entry__ as entry_points
from feedloom.suite import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(duck, ORACLES[name], QUERIES[name](spark, ORACLE)) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_profiles_orders(spark):
    rows = {r["column"]: r for r in entry_points.entry(spark).collect()}
    assert rows["o_orderkey"]["rows"] == 1500 and rows["o_orderkey"]["is_key_candidate"]
    assert rows["o_orderstatus"]["unique_count"] == 3


def test_names_follow_the_rules():
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d+_", n)]
    assert set(ORACLES) <= set(QUERIES)
