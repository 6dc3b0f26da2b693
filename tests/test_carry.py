"""Series split by time against windows over whole series."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import carry, grid, impute, quality

SCHEMA = "k string, j string, ts timestamp_ntz, v double"


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(1)
    rows = []
    for k, n in (("a", 400), ("b", 60), (None, 30), ("c", 1)):
        for h in range(n):
            rows.append((k, None if k == "b" else "x", datetime(2024, 1, 1) + timedelta(hours=h), None if r.random() < 0.4 or 100 <= h < 190 else float(r.randrange(5))))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(a.select(cols).collect()) == key(b.select(cols).collect())


@pytest.mark.parametrize("hours", [1, 7, 48, 10_000])
def test_scan_equals_windows(panel, hours):
    w = Window.partitionBy("k", "j").orderBy("ts")
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = panel.withColumn("n", F.row_number().over(w).cast("long"))
    at = F.when(F.col("v").isNotNull(), F.col("n"))
    want = n.withColumns({
        "p": F.last("v", True).over(upto), "p_at": F.last(at, True).over(upto), "q": F.first("v", True).over(ahead), "q_at": F.first(at, True).over(ahead),
        "l": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "l_at": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "f": F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)), "f_at": F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing)), "s": F.sum("v").over(upto),
    })
    v = F.col("v")
    got = carry.scan(panel, ["k", "j"], "ts", back={"p": v}, ahead={"q": v}, before={"l": v}, after={"f": v}, total={"s": v}, position="n", width=3600 * hours)
    same(got, want)


def test_lag_and_lead_with_nulls_and_ties(panel):
    two = panel.unionByName(panel).withColumn("r", F.row_number().over(Window.partitionBy("k", "j", "ts").orderBy("ts")))
    w = Window.partitionBy("k", "j").orderBy("ts", "r")
    got = carry.scan(two, ["k", "j"], "ts", before={"l": F.struct("v")}, after={"f": F.struct("v")}, order=("r",), width=3600 * 5)
    same(got.withColumns({"l": F.col("l.v"), "f": F.col("f.v")}), two.withColumns({"l": F.lag("v").over(w), "f": F.lead("v").over(w)}))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert carry.scan(none, ["k"], "ts", back={"p": F.col("v")}, total={"s": F.col("v")}, position="n").collect() == []


def test_a_long_series_is_spread_over_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        hours = spark.range(0, 200_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise("hot").alias("k"), (F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("value"))
        levels = hours.where("value IS NOT NULL").withColumnRenamed("ts", "at").withColumnRenamed("value", "level")
        made = {
            "interpolate_gaps": grid.interpolate_gaps(hours, ["k"], "ts"),
            "step_hold": grid.step_hold(hours, levels, ["k"], "ts", "at", "level", "1 hour"),
            "weekly_lag_fill": impute.weekly_lag_fill(hours, ["k"]),
            "ffill_short": impute.ffill_short(hours, ["k"]),
            "fill_by_shift": impute.fill_by_shift(hours, ["k"], 24, 2),
            "gap_runs": quality.gap_runs(hours.where("value IS NOT NULL"), ["k"]),
        }
        for name, df in made.items():
            rows = df.select(F.spark_partition_id().alias("task"), F.hash(*df.columns).alias("h"))  # no column may be pruned
            per = [r["n"] for r in rows.groupBy("task").agg(F.count("*").alias("n"), F.max("h")).collect()]
            assert len(per) == 16 and max(per) < 2.5 * sum(per) / 16, (name, sorted(per))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shifts_across_buckets_equal_shifts_of_a_whole_series(spark):
    r = random.Random(2)
    rows = [(k, "x", datetime(2024, 1, 1) + timedelta(hours=h), None if r.random() < 0.7 else float(h)) for k in "ab" for h in range(500)]
    got = {(x["k"], x["ts"]): x["v"] for x in impute.fill_by_shift(spark.createDataFrame(rows, SCHEMA), ["k"], 3, 4, value="v").collect()}
    for k in "ab":
        v = [x[3] for x in rows if x[0] == k]
        for p in range(1, 5):
            v = [x if x is not None or i < 3 * p else v[i - 3 * p] for i, x in enumerate(v)]
        assert [got[k, x[2]] for x in rows if x[0] == k] == v
