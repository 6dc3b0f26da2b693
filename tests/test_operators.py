"""Micro cases: clock changes, gaps, requeries, documents, LASSO, no look-ahead."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import checks, evaluate, explore, features, filters, forecast, gram, grid, impute, scale
from panelcast.sources import panel
from panelcast.sources.scratch import new_path
from panelcast.streaming import panel as stream

CPH = "Europe/Copenhagen"


def hours(spark, start: str, values: list, series: str = "s"):
    t = dt.datetime.fromisoformat(start)
    rows = [(series, t + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")


def values(df, col: str = "value", by: str = "ts"):
    return [r[col] for r in df.orderBy(by).collect()]


def test_spring_day_has_24_rows_and_the_mean_at_two(spark):
    g = grid.to_local_grid(hours(spark, "2016-03-26T23:00", list(range(23))), ["series"], CPH)
    f = grid.fill_skipped_hours(g, ["series"], CPH).orderBy("local").collect()
    assert len(f) == 24 and f[2]["value"] == (f[1]["value"] + f[3]["value"]) / 2
    assert [r["dst_adjustment"] for r in f].count("spring_interpolation") == 1


def test_autumn_hour_is_averaged(spark):
    v = [10.0] * 25
    v[2], v[3] = 40, 60
    g = grid.to_local_grid(hours(spark, "2016-10-29T22:00", v), ["series"], CPH).orderBy("local").collect()
    assert len(g) == 24 and g[2]["value"] == 50 and g[2]["n_utc"] == 2


def test_skipped_hour_in_helsinki_is_three(spark):
    d = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-03-31 00:00', timestamp_ntz'2024-03-31 06:00', interval 1 hour)) AS l")
    assert [r["l"].hour for r in d.where(grid.is_skipped(F.col("l"), "Europe/Helsinki")).collect()] == [3]


def test_dst_calendar(spark):
    r = grid.dst_calendar(spark, 2024, 2025).orderBy("year").collect()
    assert [(str(x["spring"]), str(x["autumn"])) for x in r] == [("2024-03-31", "2024-10-27"), ("2025-03-30", "2025-10-26")]


def test_gaps_short_long_and_at_the_edge(spark):
    d = hours(spark, "2024-01-01T00:00", [None, 1, None, None, 4, None, None, None, None, 9, None])
    r = grid.interpolate_gaps(d, ["series"], "ts").orderBy("ts").collect()
    assert [x["value"] for x in r] == [None, 1, 2, 3, 4, None, None, None, None, 9, None]
    assert sum(x["violation"] for x in r) == 6


def test_weekly_stock_is_seen_only_after_its_delay(spark):
    g = spark.sql("SELECT 's' AS series, explode(sequence(timestamp_ntz'2020-01-06', timestamp_ntz'2020-01-21', interval 1 day)) AS ts")
    lv = spark.createDataFrame([("s", dt.datetime(2020, 1, 6), 100.0), ("s", dt.datetime(2020, 1, 13), 200.0)], "series string, at timestamp_ntz, v double")
    h = grid.step_hold(g, lv, ["series"], "ts", "at", "v", "7 days")
    assert values(h, "level") == [None] * 7 + [100.0] * 7 + [200.0] * 2
    assert checks.early_levels(h, lv, ["series"], "ts", "at", "v", "7 days").count() == 0
    early = h.withColumn("level", F.when(F.dayofmonth("ts") == 19, 200.0).otherwise(F.col("level")))
    assert [r["ts"].day for r in checks.early_levels(early, lv, ["series"], "ts", "at", "v", "7 days").collect()] == [19]


def test_checks_see_part_steps_and_absent_days(spark):
    at = [(1, 0, 0), (1, 1, 0), (1, 2, 30), (1, 3, 45), (1, 4, 0), (1, 4, 0), (1, 7, 0), (3, 7, 0)]
    d = spark.createDataFrame([("s", dt.datetime(2024, 1, a, b, c), 1.0) for a, b, c in at], "series string, ts timestamp_ntz, value double")
    got = [(r["ts"].day, r["ts"].hour, r["violation"]) for r in checks.grid_violations(d, ["series"]).orderBy("ts").collect()]
    assert got == [(1, 2, "off grid"), (1, 3, "off grid"), (1, 4, "off grid"), (1, 4, "repeated"), (1, 7, "gap"), (3, 7, "gap")]
    assert [(r["day"].day, r["rows"]) for r in checks.day_violations(d, ["series"]).orderBy("day").collect()] == [(1, 7), (2, 0), (3, 1)]


def test_sparse_document(spark):
    rows = [("z", i, 79.98 if i == 13 else float(i)) for i in range(1, 97) if i != 14]
    p = spark.createDataFrame(rows, "zone string, position int, value double")
    p = p.withColumns({"start": F.lit("2024-01-01").cast("timestamp_ntz"), "end": F.lit("2024-01-02").cast("timestamp_ntz"), "resolution": F.lit("PT15M")})
    e = panel.expand_sparse_points(p, ["zone"]).orderBy("slot").collect()
    assert len(e) == 96 and e[13]["value"] == 79.98 and e[13]["ts"] == dt.datetime(2024, 1, 1, 3, 15)
    with pytest.raises(Exception, match="position beyond"):
        panel.expand_sparse_points(p.withColumn("end", F.lit("2024-01-01T12:00").cast("timestamp_ntz")), ["zone"]).collect()


def test_market_document(spark, tmp_path):
    doc = """<Publication_MarketDocument xmlns="urn:x"><TimeSeries><mRID>1</mRID><businessType>A62</businessType><curveType>A03</curveType>
<currency_Unit.name>EUR</currency_Unit.name><price_Measure_Unit.name>MWH</price_Measure_Unit.name><Period><timeInterval><start>2016-01-02T02:00Z</start><end>2016-01-02T05:00Z</end></timeInterval>
<resolution>PT60M</resolution><Point><position>1</position><price.amount>5.5</price.amount></Point><Point><position>3</position><price.amount>7</price.amount></Point></Period></TimeSeries></Publication_MarketDocument>"""
    (tmp_path / "a.xml").write_text(doc)
    (tmp_path / "b.xml").write_text("<Ack><Reason><code>999</code><text>none</text></Reason></Ack>")
    (tmp_path / "c.xml").write_text("<Ack><Reason><code>401</code><text>token</text></Reason></Ack>")
    points, bad = panel.read_market_xml(spark, str(tmp_path))
    assert [r["code"] for r in bad.collect()] == ["401"]
    e = panel.expand_sparse_points(points, ["series"])
    assert values(e) == [5.5, 5.5, 7.0]
    raw = panel.shape_raw(e.join(points.select("series", "unit", "currency").distinct(), "series"), F.lit("DK1"), "price").orderBy("timestamp_utc").collect()
    assert raw[0]["unit"] == "MWH" and raw[0]["timestamp_utc"] == dt.datetime(2016, 1, 2, 2)


def test_requery_inserts_only(spark):
    s = "zone string, resolution string, ts int, value double"
    old = spark.createDataFrame([("a", "PT60M", 1, 41.0), ("a", None, 2, None)], s)
    new = spark.createDataFrame([("a", "PT60M", 1, 51.0), ("a", None, 2, None), ("a", "PT15M", 1, 1.0), ("a", "PT15M", 1, 1.0)], s)
    merged, add, conflicts = panel.merge_requery(old, new, ["zone", "resolution", "ts"])
    assert merged.count() == 3 and add.count() == 1
    assert [(r["kept"], r["fetched"]) for r in conflicts.collect()] == [(41.0, 51.0)]
    with pytest.raises(ValueError, match="several rows"):
        panel.merge_requery(old, new.unionByName(spark.createDataFrame([("a", "PT15M", 1, 2.0)], s)), ["zone", "resolution", "ts"])


def test_unknown_zone_and_empty_filters_are_errors(spark):
    dim = panel.zone_dimension(spark)
    with pytest.raises(Exception, match="unknown zone XX"):
        panel.with_zone(spark.createDataFrame([("DK1",), ("XX",)], "zone string"), dim).collect()
    assert panel.with_zone(spark.createDataFrame([("dk1",)], "zone string"), dim).first()["tz"] == "Europe/Copenhagen"
    with pytest.raises(ValueError, match="nothing left"):
        filters.filter_psr(spark.createDataFrame([("B01",)], "psr_type string"), "B99")
    with pytest.raises(ValueError, match="no rule"):
        impute.route_fill(spark.createDataFrame([("x",)], "variable string"), "variable", {"load": lambda d: d})


def test_fills_use_the_past_alone(spark):
    v = [float(i % 168) for i in range(24 * 30)]
    for i in (0, 200, 201, 202, 203, 400, 700):
        v[i] = None
    d = hours(spark, "2024-01-01T00:00", v)
    later = d.withColumn("value", F.when(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"), F.col("value") * 9 + 1).otherwise(F.col("value")))
    for f in (lambda x: impute.weekly_lag_fill(x, ["series"]).select("ts", F.col("filled").alias("value")), lambda x: impute.impute_cascade(x, ["series"]).select("ts", "value")):
        a, b = (f(x).where("ts < timestamp_ntz'2024-01-25'") for x in (d, later))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    filled = values(impute.weekly_lag_fill(d, ["series"]), "filled")
    assert filled[0] is None and filled[200] == 32.0 and filled[400] == 64.0


def test_cross_series_regression_finds_the_line(spark):
    r = np.random.default_rng(1)
    x, z = r.normal(50, 10, 900), r.normal(20, 5, 900)
    y = 3 + 2 * x - z
    gap = [None if 800 <= i < 806 else v for i, v in enumerate(y)]
    d = hours(spark, "2024-01-01T00:00", list(x), "x").unionByName(hours(spark, "2024-01-01T00:00", list(z), "z")).unionByName(hours(spark, "2024-01-01T00:00", gap, "y"))
    out = impute.cross_series_ols_fill(d, "series").where("imputed").orderBy("ts").collect()
    assert np.allclose([o["filled"] for o in out], np.maximum(y[800:806], 0), atol=1e-6) and out[0]["imputation_predictors"] == ["x", "z"]


def test_constant_columns_scale_to_zero_and_back(spark):
    d = hours(spark, "2024-01-01T00:00", [5] * 10)
    for kind in scale.KINDS:
        p = scale.scaler_fit(d, ["series"], kind)
        t = scale.scaler_transform(d, p, ["series"], kind)
        assert p.first()["constant"] and values(scale.scaler_inverse(t.drop("value"), p, ["series"], kind)) == [5.0] * 10


def test_lasso_path_meets_its_conditions():
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 12))
    y = x[:, 0] * 3 - x[:, 3] + r.normal(size=80)
    xc, yc = x - x.mean(0), y - y.mean()
    for w in forecast.lars_path(xc.T @ xc, xc.T @ yc)[1:]:
        c = xc.T @ (yc - xc @ w)
        top = np.abs(c).max()
        on = np.abs(w) > 1e-10
        if top < 1e-6:
            continue  # the end of the path: least squares
        assert np.allclose(np.abs(c[on]), top, rtol=1e-6) and (np.sign(c[on]) == np.sign(w[on])).all()
    w, b = forecast.lasso_by_aic(x, y[:, None])[0]
    assert abs(w[0] - 3) < 0.6 and np.abs(y - x @ w - b).mean() < 1.2


def test_walk_forward_does_not_see_the_day(spark):
    n = 24 * 60
    v = [30 + 10 * np.sin(i / 24 * 2 * np.pi) + (i // 24) % 7 for i in range(n)]
    d = hours(spark, "2024-01-01T00:00", v)
    run = lambda x: forecast.walk_forward_lasso(features.lag_features(features.day_arrays(x, ["series"], ["value"]), ["series"], "value", [], (1, 7)), ["series"], [28], "2024-02-20", "2024-02-21")
    a = {(r["day"], r["slot"]): r["forecast"] for r in run(d).collect()}
    b = {(r["day"], r["slot"]): r["forecast"] for r in run(d.withColumn("value", F.when(F.col("ts") >= F.lit("2024-02-20").cast("timestamp_ntz"), 0.0).otherwise(F.col("value")))).collect()}
    first = [k for k in a if str(k[0]) == "2024-02-20"]
    assert len(a) == 48 and all(abs(a[k] - b[k]) < 1e-9 for k in first)
    truth = {(dt.date(2024, 1, 1) + dt.timedelta(days=i // 24), i % 24): x for i, x in enumerate(v)}
    assert np.mean([abs(a[k] - truth[k]) for k in a]) < 2


def test_refit_grid(spark):
    d = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2024-12-31')) AS day")
    r = d.withColumn("refit", forecast.refit_day(F.col("day"), F.lit("2023-01-01").cast("date"), 7))
    assert r.select("refit").distinct().count() == 105


def test_step_hold_stream_and_merge_stream(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), float(h) if h % 2 else None) for h in range(6)]
    path = new_path(spark, "levels")
    spark.createDataFrame(rows, "k string, ts timestamp, level double").coalesce(1).write.parquet(path)
    s = spark.readStream.schema("k string, ts timestamp, level double").parquet(path)
    got = stream.run_once(stream.step_hold(s, "k"))
    assert values(got, "level") == [None, 1.0, 1.0, 3.0, 3.0, 5.0]
    base = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 1), 9.0)], "k string, ts timestamp, level double")
    m, c = new_path(spark, "merged"), new_path(spark, "conflicts")
    q = s.where("level IS NOT NULL").writeStream.foreachBatch(stream.insert_only_merge(base, ["k", "ts"], m, c, "level")).option("checkpointLocation", new_path(spark, "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert stream.merged_rows(spark, m, base).count() == 2 and spark.read.parquet(c).count() == 1


def descent(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """LASSO weights by coordinate descent: independent of the path."""
    w, n = np.zeros(x.shape[1]), len(y)
    left, size = y.copy(), (x * x).sum(0) / len(y)
    for _ in range(4000):
        most = 0.0
        for j in np.flatnonzero(size > 1e-12):
            rho = x[:, j] @ left / n + size[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0) / size[j]
            if new != w[j]:
                left -= x[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < 1e-12:
            break
    return w


def brute_forecast(rows: list, day: dt.date, refit: dt.date, window: int, slot: int) -> float:
    train = [r for r in rows if refit - dt.timedelta(days=window - 7) <= r["day"] < refit]
    x, y = np.array([r["features"] for r in train]), np.array([r["target"][slot] for r in train])
    cont = x.shape[1] - 7
    med = np.median(x[:, :cont], 0)
    mad = np.median(np.abs(x[:, :cont] - med), 0) / 0.6744897501960817
    mad[mad == 0] = 1
    my = np.median(y)
    sy = np.median(np.abs(y - my)) / 0.6744897501960817 or 1.0
    scaled = np.hstack([np.arcsinh((x[:, :cont] - med) / mad), x[:, cont:]])
    xc, ys = scaled - scaled.mean(0), np.arcsinh((y - my) / sy)
    yc = ys - ys.mean()
    s2, best = yc.var(), None
    for knot in forecast.lars_path(xc.T @ xc, xc.T @ yc):
        w = descent(xc, yc, np.abs(xc.T @ (yc - xc @ knot)).max() / len(yc))
        aic = ((yc - xc @ w) ** 2).sum() / s2 + 2 * (np.abs(w) > 1e-9).sum()
        if best is None or aic < best[0] - 1e-9:
            best = (aic, w)
    now = np.array(next(r["features"] for r in rows if r["day"] == day))
    now = np.concatenate([np.arcsinh((now[:cont] - med) / mad), now[cont:]])
    return float(np.sinh((now - scaled.mean(0)) @ best[1] + ys.mean()) * sy + my)


def two_slots(spark, days: int):
    r = np.random.default_rng(5)
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), [float(v) for v in 20 + 5 * np.sin(i / 3) + r.normal(0, 2, 2)], [float(v) for v in r.normal(3, 1, 2)]) for i in range(days)]
    return features.lag_features(spark.createDataFrame(rows, "series string, day date, price array<double>, load array<double>"), ["series"], "price", ["load"], (1, 2), (1, 7, 0))


@pytest.mark.parametrize(("cadence", "every"), [(1, 1), (7, 1), (1, 5)])
def test_walk_forward_equals_brute_force(spark, cadence, every):
    x = two_slots(spark, 75)
    got = forecast.walk_forward_lasso(x, ["series"], [42], cadence=cadence, every=every).collect()
    rows = x.orderBy("day").collect()
    begin = rows[0]["day"] + dt.timedelta(days=42 - 7)
    want = [r["day"] for r in rows if r["day"] >= begin and (r["day"] - begin).days % every == 0]
    assert sorted({r["day"] for r in got}) == want and len(got) == 2 * len(want)
    for r in got[:: 1 if every > 1 else 5]:
        gap = (r["day"] - begin).days
        refit = begin + dt.timedelta(days=gap // cadence * cadence)
        assert abs(r["forecast"] - brute_forecast(rows, r["day"], refit, 42, r["slot"])) < 1e-4, r


def test_feature_names_follow_the_features(spark):
    names = features.feature_names((1, 2), ["load"], (1, 7, 0), 2)
    assert names[:4] == ["price_D-1_h0", "price_D-2_h0", "price_D-1_h1", "price_D-2_h1"] and names[4:7] == ["load_D-1_h0", "load_D-7_h0", "load_D_h0"]
    assert len(names) == 17 and len(two_slots(spark, 10).first()["features"]) == 17
    assert len(features.feature_names((1, 2, 3, 7), ["a", "b"], (1, 7, 0))) == 96 + 72 * 2 + 7
    blocks = {"A": {"price": (1, 7), "load": (0,)}, "B": {"price": (1,)}}
    assert features.zone_block_names(blocks, slots=2) == ["weekday", "A_price_D-1_h0", "A_price_D-1_h1", "A_price_D-7_h0", "A_price_D-7_h1", "A_load_D_h0", "A_load_D_h1", "B_price_D-1_h0", "B_price_D-1_h1"]
    assert features.zone_block_labels(blocks, slots=1) == [("calendar", "calendar"), ("A", "A/price"), ("A", "A/price"), ("A", "A/load"), ("B", "B/price")]


def test_collinear_columns_enter_once():
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 6))
    x = np.hstack([x, x[:, :2], np.zeros((60, 1))])
    xc = x - x.mean(0)
    y = xc[:, 0] + 0.3 * r.normal(size=60)
    path = forecast.lars_path(xc.T @ xc, xc.T @ (y - y.mean()))
    assert np.isfinite(path).all() and len(path) < 60
    w, b = forecast.lasso_by_aic(x, np.stack([y, np.ones(60)], 1))[0]
    assert np.abs(y - x @ w - b).mean() < 0.5


def test_small_p_values_are_not_lost(spark):
    d = spark.createDataFrame([("x", "y", float(v)) for v in np.random.default_rng(1).normal(5, 1, 400)], "a string, b string, d double")
    p = evaluate.dm_test(d, ["a", "b"]).first()["p_value"]
    assert 0 < p < 1e-300 or p == 0.0  # about exp(-5000): below the least double
    d = d.withColumn("d", F.col("d") - 4.5)
    assert 0 < evaluate.dm_test(d, ["a", "b"]).first()["p_value"] < 1e-16


def test_requery_rows_of_other_metadata_are_one(spark):
    s = "zone string, resolution string, ts int, value double, note string"
    old = spark.createDataFrame([("a", "PT60M", 1, 1.0, "x")], s)
    new = spark.createDataFrame([("a", "PT60M", 2, 5.0, "x"), ("a", "PT60M", 2, 5.0, "y")], s)
    assert panel.merge_requery(old, new, ["zone", "resolution", "ts"])[1].count() == 1


def test_pairwise_tiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    x = 1e6 + r.normal(size=(300, 30)) @ r.normal(size=(30, 30))
    x[r.random(x.shape) < 0.3] = np.nan
    x[:, 7], x[1:, 9] = 5.0, np.nan
    rows = [(f"s{j:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), float(x[i, j])) for i in range(300) for j in range(30) if x[i, j] == x[i, j]]
    d = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")
    got = {(p["a"], p["b"]): p for p in gram.pairwise(d, "series", block=8).collect()}
    for i in range(30):
        for j in range(i, 30):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            p = got.pop((f"s{i:02d}", f"s{j:02d}"), None)
            assert (p is None) == (ok.sum() == 0)
            if p is not None:
                assert p["obs"] == ok.sum()
                c = np.cov(x[ok, i], x[ok, j]) if ok.sum() > 1 else None
                assert p["cov"] is None if c is None else abs(p["cov"] - c[0, 1]) < 1e-6
                defined = c is not None and c[0, 0] > 1e-9 and c[1, 1] > 1e-9
                assert abs(p["corr"] - c[0, 1] / (c[0, 0] * c[1, 1]) ** 0.5) < 1e-9 if defined else p["corr"] is None
    assert not got and explore.pairwise(d.limit(0), "series").count() == 0


def test_two_thousand_series_make_no_row_for_a_pair_and_a_stamp(spark):
    n, stamps = 2000, 6
    d = spark.range(n * stamps).select((F.col("id") % n).cast("string").alias("series"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor(F.col("id") / n).cast("int"))).alias("ts"), F.rand(1).alias("value"))
    p = explore.pairwise(d, "series")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert p.count() == n * (n + 1) // 2 and "CartesianProduct" not in plan and "_t" not in plan.split("Join")[0]


def test_prefix_medians_of_a_million_values():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 200):
        v, at = r.integers(0, 9, n) * 0.5, r.integers(0, n + 1, 40)
        got = impute.prefix_medians(v, at)
        assert all((np.isnan(g) if k == 0 else g == np.median(v[:k])) for g, k in zip(got, at, strict=True))
    v, at = r.normal(size=1_000_000), r.integers(1, 1_000_000, 300_000)
    t = time.time()
    got = impute.prefix_medians(v, at)
    assert time.time() - t < 20 and all(got[i] == np.median(v[: at[i]]) for i in range(20))


def test_each_zone_has_its_own_clock(spark):
    h = hours(spark, "2024-03-30 20:00", list(range(12)), "DK1").withColumn("tz", F.lit(CPH))
    h = h.unionByName(hours(spark, "2024-03-30 20:00", list(range(12)), "FI").withColumn("tz", F.lit("Europe/Helsinki")))
    g = grid.fill_skipped_hours(grid.to_local_grid(h, ["series", "tz"], F.col("tz")), ["series", "tz"], F.col("tz"))
    got = {(r["series"], r["local"].hour): r["value"] for r in g.where("dst_adjustment = 'spring_interpolation'").collect()}
    assert got == {("DK1", 2): 4.5, ("FI", 3): 4.5}


def test_member_files_by_number_and_kind(spark):
    path = new_path(spark, "run")
    day = lambda n, v: spark.createDataFrame([(dt.date(2024, 1, n), v)], "day date, slots array<double>")
    kinds = {"cw": "window", "seed": "seed"}
    panel.write_member_file(day(1, [float(i) for i in range(24)]), path, "cw112")
    panel.write_member_file(day(2, [None, *[1.0] * 23]), path, "cw56")  # not whole
    panel.write_member_file(day(1, [0.0] * 24), path, "notes")
    got = panel.read_member_files(spark, path, kinds)
    assert got.count() == 24 and got.where("kind = 'window' AND member = 112 AND slot = forecast").count() == 24
    panel.write_member_file(day(1, [2.0] * 24), path, "seed3")
    with pytest.raises(ValueError, match="seed and window"):
        panel.read_member_files(spark, path, kinds)
    assert [r["member"] for r in panel.read_member_files(spark, path, kinds, "seed").select("member").distinct().collect()] == [3]
    assert panel.read_member_files(spark, new_path(spark, "none"), kinds).count() == 0
