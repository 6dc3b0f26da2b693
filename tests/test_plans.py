"""Registered queries where a table's order, size or gaps once changed their rows."""

from __future__ import annotations

import datetime as dt

import oracle
from pyspark.sql import functions as F

from panelcast.plans import registry
from panelcast.sources import panel

DIR = "/root/testdata/sf0.001"


def agrees(spark, name: str, sf_dir: str = DIR) -> str:
    return oracle.compare(spark, oracle.views(sf_dir), registry.queries()[name], registry.oracle_sql()[name], sf_dir)


def test_empty_capacities_do_not_depend_on_the_order_of_zones(spark, monkeypatch):
    zones = panel.zone_dimension
    monkeypatch.setattr(panel, "zone_dimension", lambda s: zones(s).orderBy(F.desc("zone")))
    assert agrees(spark, "a10_capacity_empty") == ""


def hourly_events(spark, values: dict[dt.datetime, list[float]], tmp_path) -> str:
    """A folder with events of one type that have these values in these hours."""
    rows = [(i, t + dt.timedelta(seconds=n), 1, "view", v, "{}") for i, (t, n, v) in enumerate((t, n, v) for t, vs in values.items() for n, v in enumerate(vs))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_means_one_bit_below_a_tie_are_rounded_as_in_sql(spark, tmp_path):
    hour = dt.datetime(2024, 1, 1)
    d = hourly_events(spark, {hour: [43.472812499999996]}, tmp_path)
    assert agrees(spark, "g14_day_matrix", d) == ""
    assert agrees(spark, "g15_flatten_day_matrix", d) == ""


def test_series_without_gaps_are_not_in_the_report_of_gaps(spark, tmp_path):
    hour = dt.datetime(2024, 1, 1)
    whole = hourly_events(spark, {hour + dt.timedelta(hours=h): [1.0] for h in range(30)}, tmp_path / "whole")
    gaps = hourly_events(spark, {hour + dt.timedelta(hours=h): [1.0] for h in range(30) if h not in (4, 5, 9)}, tmp_path / "gaps")
    assert agrees(spark, "q11_coverage_vs_grid", whole) == ""
    assert agrees(spark, "q11_coverage_vs_grid", gaps) == ""
    assert [tuple(r) for r in registry.queries()["q11_coverage_vs_grid"](spark, gaps).collect()] == [("view", 30, 3, 1)]
