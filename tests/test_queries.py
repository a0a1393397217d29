"""Every registered query equals its SQL form on the smallest tables."""

import pytest

from modelsieve.plans.oracle import ORACLE
from modelsieve.plans.registry import QUERIES
from tests.conftest import SF
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict = compare(spark, con, name, SF)
    assert verdict.startswith(("ok", "rows-only")), verdict
    assert "TYPES" not in verdict, verdict


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry
    rows = {r["risk_level"]: r["artifacts"] for r in entry.entry(spark).collect()}
    assert sum(rows.values()) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {"clean", "critical"} <= set(rows)
