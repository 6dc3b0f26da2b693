"""Queries of exploration, scaling, features, forecasts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from panelcast.operators import evaluate, explore, features, forecast, scale
from panelcast.plans import views as V
from panelcast.plans.registry import register
from panelcast.sources.scratch import new_path
from panelcast.plans.views import ZONES, r6, sf

FILLED = V.GRIDDED + ", filled AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gridded)"


def filled(spark, d):
    w = Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return V.gridded(spark, d).withColumn("value", F.last("value", True).over(w))


def _naive(name: str, cond: str) -> str:
    return f"SELECT a.series, a.ts, '{name}' AS member, a.value AS observed, b.value AS forecast FROM filled a JOIN filled b ON a.series = b.series AND b.ts = a.ts - {cond}"


WEEKEND = "CASE WHEN isodow(a.ts) IN (1, 6, 7) THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END"
MEMBERS = FILLED + ", members AS (" + " UNION ALL ".join([_naive("D", "INTERVAL 1 DAY"), _naive("W", "INTERVAL 7 DAY"), _naive("N", WEEKEND)]) + "), fc AS (SELECT *, CAST(ts AS DATE) AS day, hour(ts) AS slot FROM members WHERE ts >= (SELECT min(ts) FROM filled) + INTERVAL 8 DAY)"


def members(spark, d):
    f = filled(spark, d)
    out = None
    for name, m in (("D", "D"), ("W", "W"), ("N", None)):
        x = forecast.naive_forecast(f, ["series"], m).withColumn("member", F.lit(name))
        out = x if out is None else out.unionByName(x)
    first = F.broadcast(f.agg(F.min("ts").alias("_first")))
    out = out.crossJoin(first).where(F.col("ts") >= F.col("_first") + F.expr("interval 8 days")).drop("_first")
    return out.withColumn("day", F.to_date("ts")).withColumn("slot", F.hour("ts"))


KS, KSM = ["series"], ["series", "member"]


@register("flagship_naive_rmae", f"WITH {MEMBERS}, s AS (SELECT series, avg(abs(observed - forecast)) AS mae FROM fc WHERE member = 'D' GROUP BY 1), n AS (SELECT series, avg(abs(observed - forecast)) AS naive FROM members WHERE member = 'W' GROUP BY 1) SELECT series, round(mae, 6) AS mae, round(mae / naive, 6) AS rmae FROM s JOIN n USING (series)")
def _(spark, d):
    m = members(spark, d).where("member = 'D'")
    s = m.groupBy("series").agg(evaluate.mae().alias("mae"))
    return r6(s.join(evaluate.relative_mae(m, filled(spark, d), KS, [], "W", "rmae"), "series"), "mae", "rmae")


@register("a1_pivot_panel", f"WITH {V.HOURLY} SELECT ts, " + ", ".join(f"round(max(value) FILTER (series = '{z}'), 6) AS {z}" for z in ZONES) + " FROM hourly GROUP BY ts")
def _(spark, d):
    return r6(explore.pivot_panel(V.hourly(spark, d), "ts", "series", ZONES), *ZONES)


@register("a2_zone_dispersion", f"WITH {V.GRIDDED} SELECT series, count(value) AS obs, min(ts) FILTER (value IS NOT NULL) AS first, max(ts) FILTER (value IS NOT NULL) AS last, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM gridded GROUP BY 1")
def _(spark, d):
    return r6(explore.dispersion(V.gridded(spark, d), KS), "mean", "std", "min", "max")


PAIRS = "p AS (SELECT x.series AS a, y.series AS b, covar_samp(x.value, y.value) AS cov, corr(x.value, y.value) AS corr, count(*) AS obs FROM lines x JOIN lines y ON x.ts = y.ts AND x.series <= y.series GROUP BY ALL)"


@register("a3_pairwise", f"WITH {V.LINES}, {PAIRS} SELECT a, b, round(cov / 1e6, 2) AS cov, round(corr, 6) AS corr, obs FROM p")
def _(spark, d):
    p = explore.pairwise(V.lines(spark, d), "series")
    return p.select("a", "b", F.round(F.col("cov") / 1e6, 2).alias("cov"), F.round("corr", 6).alias("corr"), "obs")


@register("a4_top_bottom_pairs", f"WITH {V.LINES}, {PAIRS}, q AS (SELECT a, b, round(corr, 6) AS corr FROM p WHERE a < b) SELECT * FROM (SELECT *, 'top' AS side FROM q ORDER BY corr DESC, a, b LIMIT 3) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM q ORDER BY corr, a, b LIMIT 3)")
def _(spark, d):
    return explore.top_bottom_pairs(r6(explore.pairwise(V.lines(spark, d), "series"), "corr"), 3)


PERIODS = [("full", "1990-01-01", "2010-01-01"), ("calibration", "1995-01-01", "1999-01-01"), ("test", "1999-01-01", "2001-01-01"), ("1997", "1997-01-01", "1998-01-01")]


@register("a5_period_summary", f"WITH {V.DAILY}, per(period, a, b) AS (VALUES " + ", ".join(f"('{p}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, a, b in PERIODS) + ") SELECT series, period, count(value) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_samp(value), 3) AS std, CAST(sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives FROM daily JOIN per ON ts >= a AND ts < b GROUP BY ALL")
def _(spark, d):
    p = spark.createDataFrame(PERIODS, "period string, start string, end string")
    p = p.select("period", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    return explore.period_summary(V.daily(spark, d), p, KS).withColumns({c: F.round(c, 3) for c in ("mean", "median", "std")})


@register("a6_average_week", f"WITH {V.HOURLY} SELECT series, CAST((isodow(ts) - 1) * 24 + hour(ts) AS INTEGER) AS hour_of_week, round(avg(value), 9) AS mean, count(value) AS n FROM hourly GROUP BY ALL")
def _(spark, d):
    return explore.average_week(V.hourly(spark, d), KS).withColumn("mean", F.round("mean", 9))


@register("a7_shared_histogram", f"WITH {V.HOURLY}, e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM hourly), b AS (SELECT CAST(ts AS DATE) < DATE '2024-01-15' AS early, CAST(least(floor((value - lo) / w), 19) AS INTEGER) AS bin, w FROM hourly, e) SELECT CASE WHEN early THEN 'early' ELSE 'late' END AS period, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY early) * min(w)), 8) AS density FROM b GROUP BY early, bin")
def _(spark, d):
    period = F.when(F.to_date("ts") < F.lit("2024-01-15").cast("date"), "early").otherwise("late")
    return explore.shared_histogram(V.hourly(spark, d), period, 20).withColumn("density", F.round("density", 8))


@register("a8_stabilisation_report", f"WITH {FILLED}, r AS (SELECT series, value, CASE WHEN count(value) OVER w = 168 THEN stddev_samp(value) OVER w END AS s FROM filled WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)) SELECT series, count(value) AS n, round(skewness(value), 5) AS skew, round(kurtosis(value), 5) AS kurtosis, round((max(s) - min(s)) / stddev_samp(value), 5) AS rolling_range FROM r GROUP BY 1")
def _(spark, d):
    return explore.stabilisation_report(filled(spark, d), KS).withColumns({c: F.round(c, 5) for c in ("skew", "kurtosis", "rolling_range")})


KINDS = ["F", "O", "P", "X"]


@register("a9_capacity_wide", "SELECT o_custkey, year(o_orderdate) AS year, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{k}'), 0), 2) AS \"{k}\"" for k in KINDS) + ", round(sum(o_totalprice), 2) AS \"Total\" FROM orders GROUP BY ALL")
def _(spark, d):
    o = V.table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    out = explore.capacity_wide(o, ["o_custkey", "year"], "o_orderstatus", KINDS, "o_totalprice")
    return out.withColumns({c: F.round(c, 2) for c in [*KINDS, "Total"]})


def _scaled(kind: str, expr: str, stats: str):
    sql = f"WITH {V.DAILY}, m AS (SELECT series, median(value) AS med FROM daily GROUP BY 1), c AS (SELECT d.series, {stats} FROM daily d JOIN m USING (series) GROUP BY d.series) SELECT series, ts, round({expr}, 6) AS scaled FROM daily JOIN c USING (series)"

    @register(f"x2_scaler_{kind.lower()}", sql)
    def _(spark, d):
        x = V.daily(spark, d)
        out = scale.scaler_transform(x, scale.scaler_fit(x, KS, kind), KS, kind)
        return r6(out.select("series", "ts", "scaled"), "scaled")


for _k, _e, _s in (
    ("Norm", "(value - lo) / (hi - lo)", "min(value) AS lo, max(value) AS hi"),
    ("Norm1", "2 * (value - lo) / (hi - lo) - 1", "min(value) AS lo, max(value) AS hi"),
    ("Std", "(value - mu) / sd", "avg(value) AS mu, stddev_pop(value) AS sd"),
    ("Median", "(value - med) / mad", "min(med) AS med, median(abs(value - med)) / 0.6744897501960817 AS mad"),
    ("Invariant", "asinh((value - med) / mad)", "min(med) AS med, median(abs(value - med)) / 0.6744897501960817 AS mad"),
):
    _scaled(_k, _e, _s)


@register("x6_round_trip_check", f"WITH {V.DAILY}, m AS (SELECT series, median(value) AS med FROM daily GROUP BY 1), c AS (SELECT d.series, min(med) AS med, median(abs(value - med)) / 0.6744897501960817 AS mad FROM daily d JOIN m USING (series) GROUP BY 1), z AS (SELECT series, value, med, mad, asinh((value - med) / mad) AS z FROM daily JOIN c USING (series)) SELECT series, max(abs(value - (sinh(z) * mad + med))) < 1e-3 AS exact, round(stddev_pop(z), 6) AS dispersion FROM z GROUP BY 1")
def _(spark, d):
    t = scale.round_trip_check(V.daily(spark, d), KS, "Invariant")
    return t.select("series", (F.col("max_error") < 1e-3).alias("exact"), F.round("dispersion", 6).alias("dispersion"))


ARR = FILLED + ", arr AS (SELECT series, CAST(ts AS DATE) AS day, list(value ORDER BY ts) AS v FROM filled GROUP BY ALL HAVING count(value) = 24)"


def _days(spark, d):
    return features.day_arrays(filled(spark, d), KS, ["value"])


@register("x7_lag_features", f"WITH {ARR}, j AS (SELECT a.series, a.day, a.v, b.v AS v1, c.v AS v7 FROM arr a JOIN arr b ON a.series = b.series AND b.day = a.day - 1 JOIN arr c ON a.series = c.series AND c.day = a.day - 7), u AS (SELECT series, day, unnest(range(1, 25)) AS h, v, v1, v7 FROM j) SELECT series, day, round(sum(h * (2 * v1[h] + 3 * v7[h])), 3) AS check_lags, round(sum(h * v[h]), 3) AS check_target FROM u GROUP BY ALL")
def _(spark, d):
    x = features.lag_features(_days(spark, d), KS, "value", [], (1, 7), dummies=True)
    h = F.sequence(F.lit(1), F.lit(24))
    add = lambda s, e: s + e
    lags = F.aggregate(F.transform(h, lambda i: i * (2 * F.element_at("features", 2 * i - 1) + 3 * F.element_at("features", 2 * i))), F.lit(0.0), add)
    target = F.aggregate(F.transform(h, lambda i: i * F.element_at("target", i)), F.lit(0.0), add)
    return x.select("series", "day", F.round(lags, 3).alias("check_lags"), F.round(target, 3).alias("check_target"))


BLOCKS = {z: {"value": (1, 2)} if i % 2 else {"value": (1,)} for i, z in enumerate(ZONES)}


def _blocks_sql(alias: str = "p") -> str:
    x = [f"any_value({'CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN list_concat(v1, v2) END' if i % 2 else 'v1'}) FILTER (series = '{z}')" for i, z in enumerate(ZONES)]
    y = [f"any_value(v) FILTER (series = '{z}')" for z in ZONES]
    return f"p AS (SELECT a.series, a.day, a.v, b.v AS v1, c.v AS v2 FROM arr a LEFT JOIN arr b ON a.series = b.series AND b.day = a.day - 1 LEFT JOIN arr c ON a.series = c.series AND c.day = a.day - 2), w AS (SELECT day, flatten([{', '.join(x)}]) AS x, flatten([{', '.join(y)}]) AS y FROM p GROUP BY day HAVING " + " AND ".join(f"{c} IS NOT NULL" for c in x + y) + "), zb AS (SELECT day, list_concat([CAST(isodow(day) - 1 AS DOUBLE)], x) AS f, y FROM w)"


def _zone_blocks(spark, d):
    return features.zone_blocks(_days(spark, d), "series", BLOCKS)


@register("x8_zone_blocks", f"WITH {ARR}, {_blocks_sql()} SELECT day, CAST(i - 1 AS INTEGER) AS i, round(f[i], 6) AS cell FROM zb, (SELECT unnest(range(1, 170)) AS i)")
def _(spark, d):
    return r6(_zone_blocks(spark, d).select("day", F.posexplode("features").alias("i", "cell")), "cell")


@register("x8_zone_block_labels", f"WITH {ARR}, {_blocks_sql()}, c AS (SELECT day, i, f[i] AS v FROM zb, (SELECT unnest(range(1, 170)) AS i)), n AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{n}', '{z}')" for i, (n, (z, _)) in enumerate(zip(features.zone_block_names(BLOCKS), features.zone_block_labels(BLOCKS), strict=True))) + ") t(i, name, zone)) SELECT zone, name, round(sum(v), 4) AS total, count(*) AS days FROM c JOIN n USING (i) GROUP BY ALL")
def _(spark, d):
    names, labels = features.zone_block_names(BLOCKS), features.zone_block_labels(BLOCKS)
    c = _zone_blocks(spark, d).select(F.posexplode("features").alias("i", "v"))
    at = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("i") + 1)
    return c.groupBy(at([z for z, _ in labels]).alias("zone"), at(names).alias("name")).agg(F.round(F.sum("v"), 4).alias("total"), F.count("*").alias("days"))


@register("x8_null_cells", f"WITH {V.GRIDDED}, arr AS (SELECT series, CAST(ts AS DATE) AS day, list(value ORDER BY ts) AS v FROM gridded GROUP BY ALL HAVING count(*) = 24), u AS (SELECT series, day, unnest(range(24)) AS h, unnest(v) AS v FROM arr) SELECT day, 'h' || h AS name, count(*) AS n FROM u WHERE v IS NULL GROUP BY ALL")
def _(spark, d):
    g = V.gridded(spark, d).groupBy("series", F.to_date("ts").alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("features")).where(F.size("features") == 24)
    return features.null_cells(g, [f"h{h}" for h in range(24)]).groupBy("day", "name").agg(F.count("*").alias("n"))


@register("x9_multi_zone_target", f"WITH {ARR}, {_blocks_sql()} SELECT day, CAST(i - 1 AS INTEGER) AS i, round(y[i], 6) AS cell FROM zb, (SELECT unnest(range(1, 121)) AS i)")
def _(spark, d):
    return r6(_zone_blocks(spark, d).select("day", F.posexplode("target").alias("i", "cell")), "cell")


@register("x11_sliding_starts", f"WITH {FILLED}, s AS (SELECT series, ts, sum(value) OVER w AS total, count(*) OVER w AS n FROM filled WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) SELECT series, ts, round(total, 5) AS total FROM s WHERE n = 24")
def _(spark, d):
    s = features.sliding_starts(filled(spark, d), KS)
    return s.select("series", "ts", F.round(F.aggregate("target", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


@register("x12_week_block_split", f"WITH {ARR}, b AS (SELECT series, day, (day - min(day) OVER (PARTITION BY series)) // 7 AS block FROM arr), k AS (SELECT DISTINCT series, block FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY CAST('0x' || substr(md5(series || '|' || block || '|1'), 1, 12) AS BIGINT), block) AS r, count(*) OVER (PARTITION BY series) AS n FROM k) SELECT series, day, CAST(b.block AS BIGINT) AS block, r > n - floor(n * 0.25) AS validation FROM b JOIN o USING (series, block)")
def _(spark, d):
    return features.week_block_split(_days(spark, d).select("series", "day"), KS)


@register("x13_training_days", f"WITH {ARR}, d AS (SELECT DISTINCT day FROM arr), r AS (SELECT (SELECT min(day) FROM d) + 14 + CAST(5 * i AS INTEGER) AS refit FROM range(3) t(i)) SELECT CAST(refit AS DATE) AS refit, day FROM r JOIN d ON day < refit AND day >= refit - 10 AND day >= (SELECT min(day) FROM d) + 7")
def _(spark, d):
    days = _days(spark, d).select("day")
    r = days.agg(F.min("day").alias("a")).select(F.explode(F.sequence(F.date_add("a", 14), F.date_add("a", 24), F.expr("interval 5 days"))).alias("refit"))
    return features.training_days(days, r, 10)


@register("x15_rolling_context", f"WITH {V.WIDE}, c AS (SELECT zone, ts, list(price) OVER w AS context, list(load) OVER w AS cl, list(wind) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS fw FROM wide WINDOW w AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), k AS (SELECT zone, CAST(ts AS DATE) AS day, context, cl, fw FROM c WHERE len(context) = 60 AND hour(ts) = 0) SELECT zone, day, round(context[1], 5) AS oldest, round(context[60], 5) AS newest, round(list_sum(context), 3) AS total, round(list_sum(list_transform(range(1, 61), lambda i: i * cl[i])), 5) AS past, round(list_sum(list_transform(range(1, 25), lambda i: i * fw[i])), 4) AS future FROM k")
def _(spark, d):
    w = V.wide(spark, d)
    x = features.rolling_context(w, ["zone"], w.select(F.to_date("ts").alias("day")).distinct(), 60, "ts", "price", ("load",), ("wind",))
    plain = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    tilted = lambda c: plain(F.transform(c, lambda v, i: v * (i + 1)))
    return x.select("zone", "day", F.round(F.element_at("context", 1), 5).alias("oldest"), F.round(F.element_at("context", 60), 5).alias("newest"), F.round(plain(F.col("context")), 3).alias("total"), F.round(tilted(F.col("context_load")), 5).alias("past"), F.round(tilted(F.col("future_wind")), 4).alias("future"))


@register("m1_naive_forecasts", f"WITH {MEMBERS} SELECT series, ts, member, round(observed, 6) AS observed, round(forecast, 6) AS forecast FROM fc")
def _(spark, d):
    return r6(members(spark, d).select("series", "ts", "member", "observed", "forecast"), "observed", "forecast")


@register("m3_walk_forward_lasso")
def _(spark, d):
    x = features.lag_features(_days(spark, d), KS, "value", [], (1, 2, 7))
    return forecast.walk_forward_lasso(x, KS, [14, 21])


@register("m3_walk_forward_lasso_exog")
def _(spark, d):
    """Two exogenous columns, the windows of the reference; every 91st day of the years of orders is a test day of one hour's model each."""
    w = V.wide(spark, d)
    days = features.day_arrays(w, ["zone"], ["price", "load", "wind"])
    x = features.lag_features(days, ["zone"], "price", ["load", "wind"]).withColumn("target", F.slice("target", 12, 1))
    return forecast.walk_forward_lasso(x, ["zone"], [56, 84, 1092], every=91)


@register("m5_refit_schedule", f"WITH {ARR}, d AS (SELECT DISTINCT day FROM arr), b AS (SELECT min(day) AS b FROM d) SELECT day, CAST(b + CAST(((day - b) // 7) * 7 AS INTEGER) AS DATE) AS refit FROM d, b")
def _(spark, d):
    days = _days(spark, d).select("day").distinct()
    begin = days.agg(F.min("day").alias("_begin"))  # one row
    return days.crossJoin(F.broadcast(begin)).select("day", forecast.refit_day(F.col("day"), F.col("_begin"), 7).alias("refit"))


@register("m7_ensemble_mean", f"WITH {MEMBERS} SELECT series, ts, round(avg(forecast), 6) AS ensemble FROM fc GROUP BY ALL HAVING count(forecast) = 3")
def _(spark, d):
    return r6(forecast.ensemble_mean(members(spark, d), ["series", "ts"]), "ensemble")


@register("m8_resume_pending", f"WITH {MEMBERS}, done AS (SELECT series, day FROM fc WHERE member = 'W' AND NOT (hour(ts) = 5 AND day(ts) % 3 = 0) GROUP BY ALL HAVING count(forecast) = 24) SELECT DISTINCT series, day FROM fc WHERE (series, day) NOT IN (SELECT (series, day) FROM done)")
def _(spark, d):
    m = members(spark, d)
    part = m.where("member = 'W' AND NOT (slot = 5 AND day(day) % 3 = 0)")
    return forecast.resume_pending(m.select("series", "day").distinct(), part, KS)


@register("m8_resumed_backtest", f"WITH {MEMBERS} SELECT series, member, day(ts) // 7 AS block, ts, round(forecast, 6) AS forecast FROM fc")
def _(spark, d):
    """Half of the series in one run, a run that dies at its second lot, and one that does the rest."""
    m = members(spark, d).select("series", "member", F.floor(F.dayofmonth("ts") / 7).alias("block"), "ts", "forecast")
    parts, path, lots = ["series", "member", "block"], new_path(spark, "backtest"), []

    def naive(pending):
        lots.append(1)
        if len(lots) == 3:
            raise KeyboardInterrupt
        return m.join(pending, parts)

    forecast.run_backtest(path, m.where("series < 'f'"), naive, parts)
    try:
        forecast.run_backtest(path, m, naive, parts, at_once=8)
    except KeyboardInterrupt:
        pass
    return r6(forecast.run_backtest(path, m, naive, parts), "forecast").select(*parts, "ts", "forecast")


@register("m9_feasible_windows", f"WITH {V.DAILY}, b AS (SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS \"end\" FROM daily) SELECT first, CAST(\"end\" - 727 AS DATE) AS begin, \"end\", w AS \"window\", w >= 56 AND \"end\" - 727 - w >= first AS fits FROM b, (VALUES (28), (56), (84), (1092), (1456), (2000)) t(w)")
def _(spark, d):
    return forecast.feasible_windows(V.daily(spark, d), [28, 56, 84, 1092, 1456, 2000])


@register("e8_accuracy_table", f"WITH {MEMBERS} SELECT series, member, round(avg(abs(observed - forecast)), 6) AS mae, round(sqrt(avg((observed - forecast) ** 2)), 6) AS rmse, round(CASE WHEN NOT bool_or(observed = 0) THEN avg(abs(observed - forecast) / abs(observed)) END, 6) AS mape, round(avg(abs(observed - forecast) / ((abs(observed) + abs(forecast)) / 2)), 6) AS smape, count(*) AS hours_scored FROM fc GROUP BY ALL")
def _(spark, d):
    return r6(evaluate.scores(members(spark, d), KSM), "mae", "rmse", "mape", "smape")


def _relative(name: str, m: str | None, tag: str, before: str | None = None):
    cond = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", None: WEEKEND}[m]

    @register(name, f"WITH {MEMBERS}, n AS (SELECT series, avg(abs(observed - forecast)) AS nm FROM ({_naive('x', cond)}){f" WHERE ts < TIMESTAMP '{before}'" if before else ''} GROUP BY 1) SELECT fc.series, member, round(avg(abs(observed - forecast)) / min(nm), 6) AS {tag} FROM fc JOIN n ON n.series = fc.series GROUP BY fc.series, member")
    def _(spark, d):
        panel = filled(spark, d)
        if before:
            panel = panel.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
        return r6(evaluate.relative_mae(members(spark, d), panel, KS, ["member"], m, tag), tag)


_relative("e5_mase", "D", "mase", "2024-01-16")
_relative("e6_rmae", None, "rmae")
_relative("e7_rmae_weekly", "W", "rmae")

LP = "lp AS (SELECT x.series, x.day, x.slot, x.member AS a, y.member AS b, abs(x.observed - x.forecast) - abs(y.observed - y.forecast) AS d FROM fc x JOIN fc y ON x.series = y.series AND x.ts = y.ts AND x.member <> y.member), ld AS (SELECT series, a, b, day, avg(d) AS d FROM lp GROUP BY ALL)"
AB = ["series", "a", "b"]


def _pairs(spark, d, norm: int = 1):
    return evaluate.loss_pairs(members(spark, d).select("series", "day", "slot", "member", "observed", "forecast"), KS, ["day", "slot"], norm)


@register("e9_dm_univariate", f"WITH {MEMBERS}, {LP}, g AS (SELECT series, a, b, CAST(slot AS INTEGER) AS slot, count(*) AS n, CASE WHEN var_pop(d) > 0 THEN avg(d) / sqrt(var_pop(d) / count(*)) END AS stat FROM lp GROUP BY ALL) SELECT * REPLACE (round(stat, 5) AS stat), round({sf('stat')}, 6) AS p_value FROM g")
def _(spark, d):
    return evaluate.dm_test(_pairs(spark, d), [*AB, "slot"]).withColumns({"stat": F.round("stat", 5), "p_value": F.round("p_value", 6)})


@register("e10_dm_multivariate", f"WITH {MEMBERS}, {LP}, g AS (SELECT series, a, b, count(*) AS n, CASE WHEN var_pop(d) > 0 THEN avg(d) / sqrt(var_pop(d) / count(*)) END AS stat FROM ld GROUP BY ALL) SELECT * REPLACE (round(stat, 5) AS stat), round({sf('stat')}, 6) AS p_value FROM g")
def _(spark, d):
    return evaluate.dm_test(evaluate.daily_losses(_pairs(spark, d), AB), AB).withColumns({"stat": F.round("stat", 5), "p_value": F.round("p_value", 6)})


GW = "lg AS (SELECT *, lag(d) OVER (PARTITION BY {p} ORDER BY day) AS l FROM {t}), sm AS (SELECT {p}, sum(d) FILTER (l IS NOT NULL) AS sa, sum(d * l) AS sb, sum(d * d) FILTER (l IS NOT NULL) AS c11, sum(d * d * l) AS c12, sum(d * l * d * l) AS c22, {m} AS m FROM lg GROUP BY {p}), gs AS (SELECT {p}, sign(m) * (sa * sa * c22 - 2 * sa * sb * c12 + sb * sb * c11) / (c11 * c22 - c12 * c12) AS stat FROM sm) SELECT {p}, round(stat, 5) AS stat, round(CASE WHEN stat >= 0 THEN exp(-stat / 2) ELSE 1 END, 5) AS p_value FROM gs"


@register("e11_gw_univariate", f"WITH {MEMBERS}, {LP}, lps AS (SELECT series, a, b, CAST(slot AS INTEGER) AS slot, day, d FROM lp), " + GW.format(p="series, a, b, slot", t="lps", m="avg(d)"))
def _(spark, d):
    g = evaluate.gw_test(_pairs(spark, d), [*AB, "slot"], "day")
    return g.withColumns({c: F.round(c, 5) for c in ("stat", "p_value")})


@register("e11_gw_multivariate", f"WITH {MEMBERS}, {LP}, " + GW.format(p="series, a, b", t="ld", m="avg(d) FILTER (l IS NOT NULL)"))
def _(spark, d):
    g = evaluate.gw_test(evaluate.daily_losses(_pairs(spark, d), AB), AB, "day", False)
    return g.withColumns({c: F.round(c, 5) for c in ("stat", "p_value")})


@register("e12_gw_unconditional", f"WITH {MEMBERS}, {LP}, g AS (SELECT series, a, b, sign(sum(d)) * sum(d) * sum(d) / sum(d * d) AS stat FROM ld GROUP BY ALL) SELECT series, a, b, round(stat, 5) AS stat, round(CASE WHEN stat >= 0 THEN 2 * ({sf('sqrt(abs(stat))')}) ELSE 1 END, 6) AS p_value FROM g")
def _(spark, d):
    g = evaluate.gw_unconditional(evaluate.daily_losses(_pairs(spark, d), AB), AB)
    return g.withColumns({"stat": F.round("stat", 5), "p_value": F.round("p_value", 6)})


@register("e13_pairwise_matrix", f"WITH {MEMBERS}, {LP}, g AS (SELECT series, a, b, avg(d) / sqrt(var_pop(d) / count(*)) AS stat FROM ld GROUP BY ALL), p AS (SELECT series, a, b, {sf('stat')} AS p FROM g UNION ALL SELECT DISTINCT series, a, a, 1.0 FROM g) SELECT series, a, " + ", ".join(f"round(any_value(p) FILTER (b = '{x}'), 6) AS \"{x}\"" for x in "DNW") + " FROM p GROUP BY series, a")
def _(spark, d):
    t = evaluate.dm_test(evaluate.daily_losses(_pairs(spark, d), AB), AB)
    return r6(evaluate.pairwise_matrix(t, KS, list("DNW")), *"DNW")


PAIRED = "lp2 AS (SELECT x.series, x.day, x.slot, x.member AS a, y.member AS b, abs(x.observed - x.forecast) - abs(y.observed - y.forecast) AS d FROM fc2 x JOIN fc2 y ON x.series = y.series AND x.ts = y.ts AND x.member <> y.member), ld2 AS (SELECT series, a, b, day, avg(d) AS d FROM lp2 GROUP BY ALL), "
#: Two members, one of them twice under another name, so that identical forecasts occur.
TWINS = "fc2 AS (SELECT series, ts, member, observed, forecast, day, slot FROM fc UNION ALL SELECT series, ts, 'D2', observed, forecast, day, slot FROM fc WHERE member = 'D'), " + PAIRED
CMP = "dmt AS (SELECT series, a, b, count(*) AS days, max(abs(d)) AS top, CASE WHEN var_pop(d) > 0 THEN avg(d) / sqrt(var_pop(d) / count(*)) END AS dm FROM ld2 GROUP BY ALL), gwt AS (" + GW.format(p="series, a, b", t="ld2", m="avg(d) FILTER (l IS NOT NULL)").replace("lg AS", "WITH lg AS", 1).replace("/ (c11 * c22 - c12 * c12) AS stat", "/ nullif(c11 * c22 - c12 * c12, 0) AS stat").replace("round(stat, 5) AS stat, round(CASE WHEN stat >= 0 THEN exp(-stat / 2) ELSE 1 END, 5) AS p_value", "stat, CASE WHEN stat >= 0 THEN exp(-stat / 2) WHEN stat < 0 THEN 1 END AS p") + "), cmp AS (SELECT dmt.series, dmt.a, dmt.b, days, dm, gwt.stat AS gw, gwt.p AS gwp, CASE WHEN top = 0 THEN 'identical forecasts' WHEN days < {n} THEN 'too few days' WHEN dm IS NULL OR gwt.stat IS NULL THEN 'degenerate' END AS reason FROM dmt JOIN gwt ON dmt.series = gwt.series AND dmt.a = gwt.a AND dmt.b = gwt.b) SELECT series, a, b, days, reason, round(CASE WHEN reason IS NULL THEN dm END, 5) AS dm_stat, round(CASE WHEN reason IS NULL THEN {p} END, 6) AS dm_p, round(CASE WHEN reason IS NULL THEN gw END, 5) AS gw_stat, round(CASE WHEN reason IS NULL THEN gwp END, 6) AS gw_p FROM cmp"


def _compare(name: str, least: int):
    @register(name, f"WITH {MEMBERS}, {TWINS}" + CMP.replace("{n}", str(least)).replace("{p}", sf("dm")))
    def _(spark, d):
        m = members(spark, d).select("series", "day", "slot", "member", "observed", "forecast")
        m = m.unionByName(m.where("member = 'D'").withColumn("member", F.lit("D2")))
        c = evaluate.compare(evaluate.loss_pairs(m, KS, ["day", "slot"]), AB, least=least)
        return c.select(*AB, "days", "reason", *[F.round(x, 5 if x.endswith("stat") else 6).alias(x) for x in ("dm_stat", "dm_p", "gw_stat", "gw_p")])


_compare("e14_compare", 10)
_compare("e14_compare_too_few_days", 60)


@register("e16_compare_zones", f"WITH {MEMBERS}, n AS (SELECT series, avg(abs(observed - forecast)) AS nm FROM ({_naive('x', 'INTERVAL 7 DAY')}) GROUP BY 1) SELECT fc.series, " + ", ".join(f"round(avg(abs(observed - forecast)) FILTER (member = '{m}'), 6) AS \"mae_{m}\", round(avg(abs(observed - forecast)) FILTER (member = '{m}') / min(nm), 6) AS \"rmae_{m}\"" for m in "DNW") + " FROM fc JOIN n ON n.series = fc.series GROUP BY 1")
def _(spark, d):
    m = members(spark, d)
    s = evaluate.scores(m, KSM).select(*KSM, "mae").join(evaluate.relative_mae(m, filled(spark, d), KS, ["member"], "W", "rmae"), KSM)
    p = s.groupBy("series").pivot("member", ["D", "N", "W"]).agg(F.first("mae").alias("mae"), F.first("rmae").alias("rmae"))
    return p.select("series", *[F.round(f"{m}_{c}", 6).alias(f"{c}_{m}") for m in "DNW" for c in ("mae", "rmae")])


@register("e17_running_metrics", f"WITH {MEMBERS}, g AS (SELECT series, member, day, sum(abs(observed - forecast)) AS e, sum(abs(observed - forecast) / ((abs(observed) + abs(forecast)) / 2)) AS s, count(*) AS n FROM fc GROUP BY ALL) SELECT series, member, day, round(sum(e) OVER w / sum(n) OVER w, 6) AS mae, round(sum(s) OVER w / sum(n) OVER w, 6) AS smape FROM g WINDOW w AS (PARTITION BY series, member ORDER BY day)")
def _(spark, d):
    return r6(evaluate.running_metrics(members(spark, d), KSM), "mae", "smape")


@register("e18_normalised_mae", f"WITH {MEMBERS}, x AS (SELECT series || ' ' || member AS series, slot, observed, forecast FROM fc), md AS (SELECT series, slot, median(observed) AS med FROM x GROUP BY ALL), sc AS (SELECT series, avg(mad) AS scale FROM (SELECT series, slot, median(abs(observed - med)) / 0.6744897501960817 AS mad FROM x JOIN md USING (series, slot) GROUP BY ALL) GROUP BY 1) SELECT x.series, round(avg(abs(observed - forecast)), 6) AS mae, round(min(scale), 6) AS scale, round(avg(abs(observed - forecast)) / min(scale), 6) AS normalised FROM x JOIN sc ON sc.series = x.series GROUP BY 1")
def _(spark, d):
    m = members(spark, d).withColumn("series", F.concat_ws(" ", "series", "member"))
    return r6(evaluate.normalised_mae(m, "series", F.col("slot")), "mae", "scale", "normalised")


@register("e21_timing_summary", "SELECT l_returnflag, count(*) AS fits, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, max(l_quantity) AS max, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    return r6(evaluate.timing_summary(V.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"), "mean", "sd")


@register("e22_backtest_progress", "WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id % 4) AS k, sum(value) AS s FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM g) SELECT event_type, CAST(count(*) FILTER (k >= 4) AS BIGINT) AS days_done, max(k) FILTER (r = 1) AS members_on_latest, round(avg(s) FILTER (r <= 20), 5) AS seconds_per_day, round(100.0 * count(*) FILTER (k >= 4) / 40, 5) AS pct_done, round((40 - count(*) FILTER (k >= 4)) * avg(s) FILTER (r <= 20), 5) AS seconds_left FROM r GROUP BY 1")
def _(spark, d):
    e = V.table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("member", F.col("user_id") % 4)
    p = evaluate.backtest_progress(e, "event_type", "member", 4, 40, "value")
    return p.withColumns({c: F.round(c, 5) for c in ("seconds_per_day", "pct_done", "seconds_left")})
