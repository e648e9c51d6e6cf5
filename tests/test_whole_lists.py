"""The list queries see every order, on tables whose lists are longer than the place of the threshold."""

import os

import pytest
from check_catalog import compare, connect

from fleetfootprint.plans import catalog, catalog_sql

SF_DIR = "/root/testdata/sf0.01"
SQL = catalog_sql.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", ["q_computers", "q_exit_active", "q_chips", "q_build_fleet", "q_gpu_fill"])
def test_every_order_is_used(spark, con, name):
    assert compare(spark, con, SF_DIR, name, catalog.queries()[name], SQL[name]) is None
    rows = con.execute("SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey").fetchone()[0]
    used = con.execute(f"SELECT count(*), count(DISTINCT o_orderkey) FROM ({SQL[name]})").fetchone()
    # systems that are still listed have no reason to leave
    active = con.execute(f"SELECT count(*) FROM ({SQL['q_exit_active']}) WHERE exit_reason = 'Active'").fetchone()[0]
    assert used == ((rows - active,) * 2 if name in ("q_computers", "q_build_fleet") else (rows,) * 2)
    assert rows > 28 * catalog.THRESHOLD_RANK


def test_fill_matches_names(spark, con):
    """Most names are not those of the sheet, and their values are neither the known one nor the default."""
    got = [r for r in catalog.q_gpu_fill(spark, SF_DIR).collect() if r.accel_name is not None]
    sheet = dict(con.execute("SELECT p_type, CAST(100 + count(*) % 397 AS DOUBLE) FROM part WHERE p_type <> 'PROMO' GROUP BY 1").fetchall())
    assert len({r.accel_name for r in got}) > 20 and sum(r.accel_name not in sheet for r in got) > len(got) / 2
    assert all(r.gpu_tdp == sheet[r.accel_name] for r in got if r.accel_name in sheet and r.accel_name != "ECONOMY")
    # values of several sources at once, and of the known one
    values = {r.gpu_tdp for r in got}
    assert 55.0 in values and values - set(sheet.values()) - {55.0, 200.0}
