"""Every query of the catalogue against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from siteloom.plans.queries import ORACLES, QUERIES
from verify import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    got = rows(df.columns, df.collect())
    assert got == rows(cols, want)
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_have_no_nested_loops(spark):
    for name in ("mate_in_repeat", "gene_annot", "site_coverage", "iv_overlap", "slack_anti", "disc_count"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name
