"""Interval joins and datasets repaired in place."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from panelcast.operators import explore, intervals
from panelcast.sources import dataset, panel
from panelcast.sources.scratch import new_path

T0 = dt.datetime(2024, 1, 1)


def spans(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = T0 + dt.timedelta(seconds=r.randrange(10**6))
        out.append((i, r.choice("ab"), a, a + dt.timedelta(seconds=r.choice((0, 1, 60, 4000, 10**5, 3 * 10**6, -5)))))
    return [*out, (n, "a", None, T0), (n + 1, None, T0, T0 + dt.timedelta(days=9)), (n + 2, "a", T0, None)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_interval_joins_equal_brute_force(spark, keys):
    r = random.Random(5)
    pts = [(i, r.choice("abc"), T0 + dt.timedelta(seconds=r.randrange(10**6))) for i in range(300)] + [(300, "a", None), (301, None, T0)]
    one, two = spans(60, 1), spans(60, 2)
    p = spark.createDataFrame(pts, "i int, k string, ts timestamp_ntz")
    a = spark.createDataFrame(one, "n int, k string, a timestamp_ntz, b timestamp_ntz")
    b = spark.createDataFrame(two, "m int, k string, c timestamp_ntz, d timestamp_ntz")
    if not keys:
        a, b = a.withColumnRenamed("k", "ka"), b.withColumnRenamed("k", "kb")
    same = lambda x, y: not keys or (x == y and x is not None)
    ok = lambda x: None not in x[2:] and x[2] < x[3]
    got = sorted((x["i"], x["n"]) for x in intervals.points_in(p, a, keys, "ts", "a", "b").collect())
    assert got == sorted((i, s[0]) for i, k, t in pts for s in one if ok(s) and t is not None and same(k, s[1]) and s[2] <= t < s[3])
    got = sorted((x["n"], x["m"]) for x in intervals.overlaps(a, b, keys, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((x[0], y[0]) for x in one for y in two if ok(x) and ok(y) and same(x[1], y[1]) and x[2] < y[3] and y[2] < x[3])


def test_no_side_is_compared_with_all_of_the_other(spark):
    d = spark.createDataFrame([("s", T0, 1.0)], "series string, ts timestamp_ntz, value double")
    per = spark.createDataFrame([("p", T0, T0 + dt.timedelta(days=1))], "period string, start timestamp_ntz, end timestamp_ntz")
    raw = spark.createDataFrame([("z", "v", T0, 1.0)], "zone string, variable string, ts timestamp_ntz, value double")
    win = spark.createDataFrame([("p", "z", "v", T0, T0 + dt.timedelta(days=1))], "window string, zone string, variable string, start timestamp_ntz, end timestamp_ntz")
    for df in (explore.period_summary(d, per, ["series"]), panel.repair_windows(raw, raw, win, ["zone", "variable", "ts"])[1]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and df.count() == 1


KEY = ["zone", "day"]


def rows(spark, *data):
    return spark.createDataFrame(data, "zone string, day int, value double, note string")


def files(spark, path):
    return {f for f in dataset.read(spark, path).inputFiles()}


def content(spark, path):
    return sorted((tuple(r) for r in dataset.read(spark, path).select("zone", "day", "value", "note").collect()), key=str)


def test_a_merge_rewrites_what_it_touches_alone(spark):
    path = new_path(spark, "ds")
    first = [("a/b c", 1, 1.0, "x"), ("a/b c", 2, None, "x"), ("q", 1, 5.0, "x"), (None, 1, 7.0, "x")]
    dataset.create(rows(spark, *first), path, ["zone"])
    before = files(spark, path)
    assert content(spark, path) == sorted(first, key=str)
    add, conflicts, v = dataset.merge(spark, path, rows(spark, ("a/b c", 1, 9.0, "y"), ("a/b c", 3, 3.0, "y"), ("new", 1, 4.0, "y"), (None, 1, 7.0, "y")), KEY)
    want = sorted([*first, ("a/b c", 3, 3.0, "y"), ("new", 1, 4.0, "y")], key=str)
    assert content(spark, path) == want and v.number == 2 and add.count() == 2 and [r["fetched"] for r in conflicts.collect()] == [9.0]
    kept = files(spark, path) & before
    assert len(kept) == 2 and not any("a%2Fb" in f.split("zone=")[1] for f in kept)
    again = dataset.merge(spark, path, rows(spark, ("new", 1, 4.0, "y")), KEY)[2]
    assert again.number == 2 and content(spark, path) == want
    assert len(dataset.vacuum(spark, path)) == 0 and content(spark, path) == want  # both commits still hold rows


def test_a_crash_before_the_swap_changes_nothing(spark, monkeypatch):
    path = new_path(spark, "ds")
    dataset.create(rows(spark, ("a", 1, 1.0, "x")), path, ["zone"])
    before, publish = files(spark, path), dataset.publish
    fetched = rows(spark, ("a", 2, 2.0, "y"))

    def dies(*_):
        raise OSError("killed")

    monkeypatch.setattr(dataset, "publish", dies)
    with pytest.raises(OSError):
        dataset.merge(spark, path, fetched, KEY)
    assert files(spark, path) == before and content(spark, path) == [("a", 1, 1.0, "x")]
    monkeypatch.setattr(dataset, "publish", publish)
    dataset.merge(spark, path, fetched, KEY)
    assert content(spark, path) == [("a", 1, 1.0, "x"), ("a", 2, 2.0, "y")]
    assert len(dataset.vacuum(spark, path)) == 2 and content(spark, path) == [("a", 1, 1.0, "x"), ("a", 2, 2.0, "y")]
    with pytest.raises(Exception, match="(?i)exist"):  # a version is published once
        dataset.publish(spark, path, dataset.current(spark, path))


def test_empty_dataset(spark):
    path = new_path(spark, "ds")
    dataset.create(rows(spark, ("a", 1, 1.0, "x")).limit(0), path, ["zone"])
    assert content(spark, path) == []
    dataset.merge(spark, path, rows(spark, ("a", 1, 1.0, "x")), KEY)
    assert content(spark, path) == [("a", 1, 1.0, "x")]
