import pytest

import __spark_entry__ as entry_point
from netsentry.plans.catalog import named_queries
from oracle import SQL
from compare import database, difference
from helpers import plan

FOLDER = "/root/testdata/sf0.001"
QUERIES = named_queries()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(entry_point.oracle_sql()) and set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 222


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", ["ip_reputation", "ip_profile", "live_kpis", "analytics_lists", "ip_profile_one", "ip_one"])
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "ArrowEval" not in text


def test_top_lists_do_not_sort_everything(spark):
    for name in ("global_ip_stats", "target_ip_stats", "attacker_victim_stats", "high_risk_ips", "live_feed_latest"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
