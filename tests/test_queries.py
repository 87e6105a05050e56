"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import pytest

import __spark_entry__ as entry
from factloom.plans import queries as plans

from .oracle import DATA, compare, duck

SF = os.environ.get("TEST_SF", "sf0.001")
EMPTY_HERE = {"rules_offtake"}  # no such rows at the smallest scale


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_like_sql(spark, con, name):
    said = compare(spark, con, SF, plans.QUERIES[name], plans.ORACLE[name])
    assert not said or said == "no rows on either side" and name in EMPTY_HERE, said


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "fiscal_year", "unit", "value", "fact_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_sql(spark):
    ranked = plans.QUERIES["search_snippets"](spark, f"{DATA}/{SF}").collect()
    assert ranked and [r.rank for r in ranked] == sorted((r.rank for r in ranked), reverse=True)
    assert all("[[" in r.snippet and all(len(x.split()) <= 28 for x in r.snippet.split(" ... ")) for r in ranked)


def test_plans_push_down(spark):
    plan = plans.QUERIES["series"](spark, f"{DATA}/{SF}")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "o_orderpriority,1-URGENT" in plan and "c_acctbal" not in plan.split("Physical Plan")[-1]
