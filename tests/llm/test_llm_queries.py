"""Registered corpus queries against their SQL twins."""

from __future__ import annotations

import oracle
import pytest

from panelcast.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, oracle.views(DIR), Q.queries()[name], Q.oracle_sql()[name], DIR) == ""


def test_every_operator_is_registered():
    names = Q.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
