"""Direct plug-in beside SQL at the pilot that the table gives: the registered SQL has a row for a pilot of five only."""

import duckdb
import pytest

from scatterlake.plans import catalog

SF = "/root/testdata/sf0.1"
ASKED = {"dpi_bins": ([], [], None), "dpi_control_fe_bins": (["l_tax"], catalog.FLAGS, "l_returnflag")}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con


def at_pilot(con, name):
    columns, dummies, within = ASKED[name]
    pilot = con.execute(catalog._rot_sql(columns, within, catalog.NOISY)).fetchone()[0]
    assert pilot != catalog.PILOT
    return catalog._dpi_sql(pilot, columns, dummies, within)


@pytest.mark.parametrize("name", ASKED)
def test_bins(spark, con, name):
    assert catalog.QUERIES[name](spark, SF).first()["bins"] == con.execute(at_pilot(con, name)).fetchone()[0]
    assert con.execute(catalog.ORACLE_SQL[name]).fetchall() == []


def test_plot(spark, con):
    want = con.execute(catalog._chosen_sql(at_pilot(con, "dpi_bins"), catalog.NOISY)).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["plot_dpi"](spark, SF).collect())) == sorted(want)
