"""Every catalog query against its SQL on the driver's tables, and the plans they run with."""

import os

import pytest
from check_catalog import compare, connect

import __spark_entry__ as entry
from fleetfootprint.plans import catalog, catalog_sql
from fleetfootprint.session import own_folder, scratch

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog_sql.oracle_sql()
IMPACT = [
    "q_energy_series", "q_carbon_series", "q_carbon_series_b", "q_churn", "q_fleet_average", "q_entity_vs_fleet",
    "q_kpi_summary", "q_unpivot_long", "q_semester_expand", "q_minimal_view",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, QUERIES[name], SQL[name]) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_plan_has_no_quadratic_step(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # a frame from the current row to the end is evaluated anew for every row
    assert "currentrow$(), unboundedfollowing$()" not in plan


@pytest.mark.parametrize("name", IMPACT)
def test_impact_stays_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan and "Pandas" not in plan


def test_long_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["q_long_filter"](spark, SF_DIR))
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(l_linestatus,F)" in plan and "l_tax" not in plan


def test_top_n_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["q_edition_topn"](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") >= 2


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.count() == 14 and "total_carbon_t" in result.columns


def test_country_prunes_partitions_of_a_stored_fleet(spark):
    plan = plan_of(QUERIES["q_impact_country"](spark, SF_DIR))
    filters = [line for line in plan.split("FileScan") if "PartitionFilters" in line]
    assert any("(country#" in f.split("PartitionFilters")[1][:120] and "NATION_3" in f.split("PartitionFilters")[1][:160] for f in filters)


def test_bare_edition_table_is_cut_to_the_systems_of_the_slice(spark):
    rows = catalog.fleet(spark, SF_DIR, with_carbon=False)
    plan = plan_of(catalog.plans.impact(rows, catalog.thresholds(spark, SF_DIR), catalog.COUNTRY_SLICE, catalog.MAX_EDITION))
    assert "LeftSemi" in plan


@pytest.mark.parametrize("name", ["q_fleet_average", "q_entity_vs_fleet", "q_kpi_summary", "q_unpivot_long"])
def test_fleet_is_read_once(spark, name):
    """What is left to do reads the rows per system, not the fleet."""
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "orders.parquet" not in plan and "customer.parquet" not in plan


def test_country_is_chosen_before_the_first_aggregate(spark):
    plan = plan_of(QUERIES["q_yearly_compare"](spark, SF_DIR))
    assert plan.count("LeftSemi") >= 2 and "GreaterThanOrEqual(l_shipdate" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_queries_leave_the_session_alone(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    QUERIES["q_carbon_series"](spark, SF_DIR).collect()
    assert before == {k: spark.conf.get(k, None) for k in before}


@pytest.mark.parametrize("name", ["q_carbon_series", "q_spec_fill", "q_build_fleet"])
def test_scratch_leaves_no_files(spark, name):
    folder = own_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark):
        assert QUERIES[name](spark, SF_DIR).collect()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
