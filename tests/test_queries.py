"""Every registered query against its SQL twin."""

from __future__ import annotations

import oracle
import pytest

from panelcast.plans import registry

DIR = "/root/testdata/sf0.001"
#: Beyond SQL; tested against brute force in test_operators.
NO_SQL = {"m6_forecast_with_cadence", "m3_walk_forward_lasso", "m3_walk_forward_lasso_exog"}


@pytest.fixture(scope="module")
def con():
    return oracle.views(DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in NO_SQL and registry.queries()[name](spark, DIR).count()
    else:
        assert oracle.compare(spark, con, registry.queries()[name], sql, DIR) == ""
