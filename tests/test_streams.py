"""Streams with state, timers and growing tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelcast.sources.scratch import new_path
from panelcast.streaming import panel as stream


def test_a_stream_that_stops_is_reported_without_further_input(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [("a", t(0)), ("a", t(0, 20)), ("a", t(3)), ("a", t(3, 10)), ("a", t(3, 40)), ("b", t(1)), ("b", None)]
    path = new_path(spark, "beats")
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(path)
    s = spark.readStream.schema("k string, ts timestamp").parquet(path)
    got = stream.run_until_forgotten(stream.stalled_runs(s, "k", gap=1800, wait=2))
    assert sorted(tuple(r) for r in got.collect()) == [("a", t(0), t(0, 50), 2, False), ("a", t(3), t(3, 40), 2, False), ("a", t(3, 40), t(4, 10), 1, True), ("b", t(1), t(1, 30), 1, True)]


def test_a_batch_reads_no_more_of_a_growing_table_than_its_own_parts(spark):
    base = spark.createDataFrame([("k0", 0, 1.0)], "k string, day int, value double")
    merged, conflicts = new_path(spark, "merged"), new_path(spark, "conflicts")
    merge = stream.insert_only_merge(base, ["k", "day"], merged, conflicts, part=F.col("day"))
    for n in range(5):  # two days a batch, one of them of the batch before
        rows = [(f"k{i}", day, float(i)) for day in (n, n + 1) for i in range(50)] + [("k7", n + 1, 99.0), (None, n + 1, 0.0)]
        merge(spark.createDataFrame(rows, base.schema), n)
    first = merge.read[1]
    assert merge.read[0] == 0 and first > 0 and all(r <= 1.1 * first for r in merge.read[1:])
    got = stream.merged_rows(spark, merged, base)
    assert got.count() == 6 * 50 - 1 + 5 and got.where("value = 99").count() == 0
    assert sorted((r["k"], r["day"], r["kept"], r["fetched"]) for r in spark.read.parquet(conflicts).collect()) == [("k0", 0, 1.0, 0.0)] + [("k7", d, 7.0, 99.0) for d in range(1, 6)]
    merge(spark.createDataFrame(rows, base.schema), 4)  # a batch that is run again
    assert stream.merged_rows(spark, merged, base).count() == 6 * 50 - 1 + 5


def test_held_levels_go_on_over_batches_and_days_without_python_workers(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "k string, ts timestamp, level double, n long"
    batches = [
        [("a", t(1), None, 1), ("a", t(1, 1), 1.0, 2), ("a", t(3), None, 3), ("a", t(3), 2.0, 4), ("a", t(3), None, 5), (None, t(2), 7.0, 6), ("b", t(1), None, 7), ("a", None, None, 8)],
        [("a", t(2), 9.0, 9), ("a", t(3), None, 10), ("a", t(4), 3.0, 11), ("a", t(9), None, 12), (None, t(5), None, 13), ("b", t(4), 5.0, 14)],
        [("a", t(4), None, 15), ("b", t(3), 6.0, 16), ("b", t(4), 8.0, 17), (None, t(1), None, 18)],
    ]
    want = [
        [("a", t(1), None), ("a", t(1, 1), 1.0), ("a", t(3), 1.0), ("a", t(3), 2.0), ("a", t(3), 2.0), (None, t(2), 7.0), ("b", t(1), None), ("a", None, 2.0)],
        [("a", t(2), 2.0), ("a", t(3), 2.0), ("a", t(4), 3.0), ("a", t(9), 3.0), (None, t(5), 7.0), ("b", t(4), 5.0)],
        [("a", t(4), 3.0), ("b", t(3), 5.0), ("b", t(4), 8.0), (None, t(1), 7.0)],
    ]
    path = new_path(spark, "levels")
    spark.createDataFrame(batches[0], schema).write.parquet(path)
    hold = stream.step_hold(spark.readStream.schema(schema).parquet(path), "k", seq="n")
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    for i in (0, 1, 1, 2):  # the second batch is run again
        got = hold.work(spark.createDataFrame(batches[i], schema), i)
        assert "Pandas" not in got._jdf.queryExecution().toString() and key(got.collect()) == key(want[i])
    assert key(stream.run_once(stream.step_hold(hold.stream, "k", seq="n")).collect()) == key(want[0])
