"""Queries of layouts, zone dimensions, feature tables of several columns, and tables of several zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import evaluate, explore, features, filters, forecast, grid, impute, quality, scale
from panelcast.plans import modelling as M
from panelcast.plans import views as V
from panelcast.plans.registry import register
from panelcast.plans.views import CPH, KEY5, YEAR, ZONES, r6
from panelcast.sources import panel

Z, COLS = ["zone"], ["price", "load", "wind"]


def _days(spark, d):
    return features.day_arrays(V.wide(spark, d), Z, COLS)


def _lags(pairs: list[tuple[str, int]]) -> str:
    """SQL of the lagged arrays: warr joined with itself, columns c_k."""
    ks = sorted({k for _, k in pairs if k})
    joins = " ".join(f"JOIN warr w{k} ON w{k}.zone = w0.zone AND w{k}.day = w0.day - {k}" for k in ks)
    return "lg AS (SELECT w0.zone, w0.day, w0.price AS target, " + ", ".join(f"w{k}.{c} AS {c}_{k}" for c, k in pairs) + f" FROM warr w0 {joins})"


def _rounded(df):
    return df.select("zone", "day", F.transform("features", lambda x: V.rounded(x, 5)).alias("features"))


PRICE, EXOG = [("price", k) for k in (1, 2, 3, 7)], [(c, k) for k in (1, 7, 0) for c in ("load", "wind")]
DUMMIES = "[" + ", ".join(f"CAST(CASE WHEN isodow(day) = {i} THEN 1 ELSE 0 END AS DOUBLE)" for i in range(1, 8)) + "]"


def _feature_sql(blocks: list[list[tuple[str, int]]], first: str = "", last: str = "") -> str:
    pairs = [p for b in blocks for p in b]
    parts = [f"flatten(list_transform(range(1, 25), lambda h: [{', '.join(f'{c}_{k}[h]' for c, k in b)}]))" for b in blocks if b]
    parts = [*([first] if first else []), *parts, *([last] if last else [])]
    return f"WITH {V.WARR}, {_lags(pairs)}, fe AS (SELECT zone, day, flatten([{', '.join(parts)}]) AS f FROM lg) SELECT zone, day, list_transform(f, lambda x: round(x, 5)) AS features FROM fe"


@register("x7_lag_features_exog", _feature_sql([PRICE, EXOG], last=DUMMIES))
def _(spark, d):
    return _rounded(features.lag_features(_days(spark, d), Z, "price", ["load", "wind"]))


@register("x10_toggled_features", _feature_sql([[("price", 1), ("price", 3)], [("load", 1), ("wind", 7), ("wind", 0)]], first="[CAST(isodow(day) - 1 AS DOUBLE)]"))
def _(spark, d):
    return _rounded(features.toggled_features(_days(spark, d), Z, "price", (1, 3), {"load": (1,), "wind": (7, 0)}))


@register("x10_continuous_weekday", "SELECT event_id, round(isodow(ts) - 1 + hour(ts) / 24.0, 6) AS day FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", F.round(features.continuous_weekday(F.col("ts")), 6).alias("day"))


@register("x14_zone_matrices", f"WITH {V.HOURLY}, x AS (SELECT series, ts, CASE WHEN day(ts) = 7 AND hour(ts) = 5 THEN NULL ELSE value END AS value FROM hourly WHERE NOT (series = 'view' AND day(ts) = 12)), g AS (SELECT series, CAST(ts AS DATE) AS day, count(*) AS n, count(value) AS k FROM x GROUP BY ALL), v AS (SELECT series, day, CASE WHEN n <> 24 THEN 'rows' WHEN k <> 24 THEN 'null' END AS problem FROM g) SELECT * FROM v WHERE problem IS NOT NULL UNION ALL SELECT s.series, t.day, 'absent' FROM (SELECT DISTINCT series FROM g) s, (SELECT DISTINCT day FROM g) t WHERE (s.series, t.day) NOT IN (SELECT (series, day) FROM g)")
def _(spark, d):
    h = V.hourly(spark, d).where("NOT (series = 'view' AND day(ts) = 12)")  # an absent day and nulls planted
    h = h.withColumn("value", F.when((F.dayofmonth("ts") == 7) & (F.hour("ts") == 5), F.lit(None)).otherwise(F.col("value")))
    return features.zone_matrices(h, "series", ["value"])[1]


@register("x14_zone_matrix_cells", f"WITH {V.WARR} SELECT zone, day, list_transform(price, lambda x: round(x, 4)) AS price, list_transform(wind, lambda x: round(x, 5)) AS wind FROM warr")
def _(spark, d):
    x, _ = features.zone_matrices(V.wide(spark, d), "zone", COLS)
    return x.select("zone", "day", F.transform("price", lambda v: V.rounded(v, 4)).alias("price"), F.transform("wind", lambda v: V.rounded(v, 5)).alias("wind"))


SPLIT = "CAST(ts AS DATE) < DATE '1998-01-01'"


@register("x4_scaling", f"WITH {V.DAILY}, f AS (SELECT series, avg(value) AS mu, stddev_pop(value) AS sd FROM daily WHERE {SPLIT} GROUP BY 1) SELECT series, ts, {SPLIT} AS fitted, round((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS scaled FROM daily JOIN f USING (series)")
def _(spark, d):
    x = V.daily(spark, d)
    early = F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")
    _, (a, b) = scale.scaling([x.where(early), x.where(~early)], ["series"], "Std")
    return r6(a.withColumn("fitted", F.lit(True)).unionByName(b.withColumn("fitted", F.lit(False))).select("series", "ts", "fitted", "scaled"), "scaled")


@register("x5_zone_scaler_report", f"WITH {V.WIDE}, x AS (SELECT zone, hour(ts) AS slot, CASE WHEN hour(ts) = 3 THEN 5.0 ELSE price END AS v FROM wide), m AS (SELECT zone, slot, median(v) AS med FROM x GROUP BY ALL), p AS (SELECT x.zone, x.slot, min(med) AS med, median(abs(v - med)) / 0.6744897501960817 AS mad FROM x JOIN m USING (zone, slot) GROUP BY ALL), z AS (SELECT x.zone, asinh((v - med) / CASE WHEN mad = 0 THEN 1 ELSE mad END) AS z FROM x JOIN p USING (zone, slot)), g AS (SELECT zone, stddev_pop(z) AS dispersion FROM z GROUP BY 1) SELECT g.zone, round(dispersion, 6) AS dispersion, true AS exact, (SELECT count(*) FROM p WHERE p.zone = g.zone AND mad = 0) AS constant_columns, round(dispersion / (SELECT min(dispersion) FROM g), 6) AS times_least FROM g")
def _(spark, d):
    w = V.wide(spark, d).withColumn("slot", F.hour("ts")).withColumn("price", F.when(F.col("slot") == 3, 5.0).otherwise(F.col("price")))  # a constant column planted
    t = scale.zone_scaler_report(w, "zone", "slot", "Invariant", "price")
    return r6(t.select("zone", "dispersion", (F.col("max_error") < 1e-3).alias("exact"), "constant_columns", "times_least"), "dispersion", "times_least")


POOL = "p{i} AS (SELECT {k}, avg(price) AS c, CASE WHEN stddev_pop(price) = 0 THEN 1 ELSE stddev_pop(price) END AS s FROM wide GROUP BY ALL)"


@register("x5_equals_pooled", f"WITH {V.WIDE}, {POOL.format(i=1, k='zone, hour(ts) AS slot')}, {POOL.format(i=2, k='hour(ts) AS slot')}, x AS (SELECT w.zone, max(abs((price - p1.c) / p1.s - (price - p2.c) / p2.s)) AS d FROM wide w JOIN p1 ON p1.zone = w.zone AND p1.slot = hour(ts) JOIN p2 ON p2.slot = hour(ts) GROUP BY 1) SELECT zone, 'columns' AS pooled, true AS equal, 0.0 AS difference FROM x UNION ALL SELECT zone, 'slots', d <= 1e-9, round(d, 6) FROM x")
def _(spark, d):
    w = V.wide(spark, d).withColumn("slot", F.hour("ts"))
    own = ["zone", "slot"]
    one = scale.equals_pooled(w, "zone", "Std", own, own, "price").withColumn("pooled", F.lit("columns"))  # a column a zone and slot: the same numbers
    two = scale.equals_pooled(w, "zone", "Std", own, ["slot"], "price").withColumn("pooled", F.lit("slots"))  # zones in one column: others
    return r6(one.unionByName(two), "difference")


DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{e}', '{t}', '{n}')" for i, (c, e, t, n) in enumerate(panel.ZONES)) + ") t(i, zone, eic, tz, name))"


def _coded(spark, d):
    """Events with a zone code, some in lower case."""
    codes = F.array(*[F.lit(z[0] if i % 5 else z[0].lower()) for i, z in enumerate(panel.ZONES)])
    return V.table(spark, d, "events").withColumn("zone", F.element_at(codes, (F.col("user_id") % len(panel.ZONES) + 1).cast("int")))


@register("s20_zone_lookup", f"WITH {DIM} SELECT name, eic, tz, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN dim ON user_id % {len(panel.ZONES)} = i GROUP BY ALL")
def _(spark, d):
    x = panel.with_zone(_coded(spark, d), panel.zone_dimension(spark))
    return x.groupBy("name", "eic", "tz").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("j9_local_hours_by_zone", f"WITH {DIM} SELECT zone, hour(timezone(tz, timezone('UTC', ts))) AS local_hour, count(*) AS n FROM events JOIN dim ON user_id % {len(panel.ZONES)} = i GROUP BY ALL")
def _(spark, d):
    x = panel.with_zone(_coded(spark, d), panel.zone_dimension(spark))
    local = F.hour(grid.to_local(F.col("ts"), F.col("tz"))).cast("long")
    return x.groupBy(F.upper("zone").alias("zone"), local.alias("local_hour")).agg(F.count("*").alias("n"))


CAP = f"cap AS (SELECT d.zone, d.name AS area_name, d.eic, year(o_orderdate) AS year, 'B' || lpad(CAST(1 + o_orderkey % 27 AS VARCHAR), 2, '0') AS psr_type, sum(o_totalprice) AS value FROM orders JOIN dim d ON o_custkey % 7 = i WHERE NOT (o_custkey % 7 = 3 AND year(o_orderdate) = 1997) GROUP BY ALL)"
NAMES = "nm AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in filters.PSR_NAMES.items()) + ") t(psr_type, n))"


def _capacity(spark, d):
    o = V.table(spark, d, "orders").where("NOT (o_custkey % 7 = 3 AND year(o_orderdate) = 1997)")
    codes = F.array(*[F.lit(z[0]) for z in panel.ZONES])
    zone = F.element_at(codes, (F.col("o_custkey") % 7 + 1).cast("int"))
    psr = F.concat(F.lit("B"), F.lpad((1 + F.col("o_orderkey") % 27).cast("string"), 2, "0"))
    rows = o.groupBy(zone.alias("zone"), F.year("o_orderdate").cast("long").alias("year"), psr.alias("psr_type")).agg(F.sum("o_totalprice").alias("value")).withColumn("unit", F.lit("MW"))
    expected = panel.zone_dimension(spark).select("zone").where(F.col("zone").isin([z[0] for z in panel.ZONES[:7]])).crossJoin(V.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct())
    return explore.capacity_long(rows, panel.zone_dimension(spark), filters.PSR_NAMES, expected)


@register("a10_capacity_long", f"WITH {DIM}, {CAP}, {NAMES} SELECT zone, area_name, eic, year, psr_type, coalesce(n, psr_type) AS production_type, round(value, 2) AS value, 'MW' AS unit FROM cap LEFT JOIN nm USING (psr_type)")
def _(spark, d):
    return _capacity(spark, d)[0].withColumn("value", F.round("value", 2))


@register("a10_capacity_empty", f"WITH {DIM}, {CAP} SELECT zone, year FROM (SELECT zone FROM dim WHERE i < 7), (SELECT DISTINCT year(o_orderdate) AS year FROM orders) WHERE (zone, year) NOT IN (SELECT (zone, year) FROM cap)")
def _(spark, d):
    return _capacity(spark, d)[1]


@register("g18_dst_calendar", "WITH y AS (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year FROM orders), e AS (SELECT year, make_date(year, 3, 31) AS a, make_date(year, 10, 31) AS b FROM y) SELECT CAST(year AS INTEGER) AS year, CAST(a - CAST(isodow(a) % 7 AS INTEGER) AS DATE) AS spring, CAST(b - CAST(isodow(b) % 7 AS INTEGER) AS DATE) AS autumn FROM e")
def _(spark, d):
    years = V.table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    return grid.dst_calendar(spark, years["a"], years["b"])


@register("g14_dst_report", f"WITH {V.HOURLY}, {YEAR}, g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM year WHERE NOT (series = 'view' AND month(ts) = 3 AND day(ts) > 29) GROUP BY 1), l AS (SELECT series, {CPH.format('ts')} AS local FROM g WHERE NOT (series = 'view' AND month(ts) = 3 AND day(ts) > 29)), c AS (SELECT series, CAST(local AS DATE) AS day, count(*) AS n, count(DISTINCT local) AS k FROM l GROUP BY ALL), r AS (SELECT series, coalesce(list(day ORDER BY day) FILTER (n = 23 AND k = 23), []) AS spring, coalesce(list(day ORDER BY day) FILTER (n = 25 AND k = 24), []) AS autumn FROM c GROUP BY 1) SELECT series, array_to_string(spring, ',') AS spring, array_to_string(autumn, ',') AS autumn, (SELECT count(DISTINCT (spring, autumn)) FROM r) = 1 AS equal FROM r")
def _(spark, d):
    off = "NOT (series = 'view' AND month(ts) = 3 AND day(ts) > 29)"  # one series without the days around the change
    g = grid.complete_grid(V.spring(spark, d).where(off), ["series"], "ts").where(off)
    r = grid.dst_report(g.select("series", grid.to_local(F.col("ts"), "Europe/Copenhagen").alias("local")), ["series"], "local")
    return r.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("spring", "autumn")})


@register("g17_snap_levels", f"WITH s AS (SELECT event_type, ts, value, event_id, timezone('UTC', timezone('Europe/Copenhagen', date_trunc('day', {CPH.format('ts')} + INTERVAL 12 HOUR))) AS snapped FROM events) SELECT event_type, snapped, arg_min(value, event_id) AS value FROM s GROUP BY ALL")
def _(spark, d):
    return grid.snap_levels(V.table(spark, d, "events"), ["event_type"], "Europe/Copenhagen", seq="event_id")[0]


@register("g17_not_monday", f"WITH s AS (SELECT event_type, ts, timezone('UTC', timezone('Europe/Copenhagen', date_trunc('day', {CPH.format('ts')} + INTERVAL 12 HOUR))) AS snapped FROM events) SELECT event_type, ts, snapped FROM s WHERE isodow({CPH.format('snapped')}) <> 1")
def _(spark, d):
    return grid.snap_levels(V.table(spark, d, "events"), ["event_type"], "Europe/Copenhagen", seq="event_id")[1]


@register("g1_coarse_rows", f"WITH {V.RAW} SELECT zone, CASE WHEN ingest_seq % 11 = 0 THEN 'P1D' ELSE 'P7D' END AS resolution, count(*) AS rows FROM raw WHERE ingest_seq % 11 = 0 OR ingest_seq % 13 = 0 GROUP BY ALL")
def _(spark, d):
    r = F.when(F.col("ingest_seq") % 11 == 0, "P1D").when(F.col("ingest_seq") % 13 == 0, "P7D").otherwise(F.col("resolution"))  # planted
    return grid.coarse_rows(V.raw(spark, d).withColumn("resolution", r), ["zone"])


AUDIT = "a AS (SELECT zone, variable, psr_type, resolution, ts, count(*) AS copies FROM raw GROUP BY ALL HAVING count(*) > 1)"


@register("q1_copies_histogram", f"WITH {V.RAW}, {AUDIT} SELECT copies, count(*) AS keys FROM a GROUP BY 1")
def _(spark, d):
    return quality.copies_histogram(quality.duplicate_audit(V.raw(spark, d), KEY5))


@register("q1_by_day_of_month", f"WITH {V.RAW}, {AUDIT} SELECT CAST(day(ts) AS INTEGER) AS day_of_month, count(*) AS keys, CAST(sum(copies - 1) AS BIGINT) AS redundant FROM a GROUP BY 1")
def _(spark, d):
    return quality.duplicates_by_day_of_month(quality.duplicate_audit(V.raw(spark, d), KEY5), "ts")


@register("q18_series_summary", f"WITH {V.RAW}, t AS (SELECT zone, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS overlapping FROM (SELECT zone, ts, count(DISTINCT resolution) AS k FROM raw GROUP BY ALL) GROUP BY 1), h AS (SELECT zone, date_trunc('hour', ts) AS hour, count(*) AS n, max(value) - min(value) AS spread FROM raw WHERE zone <> 'view' GROUP BY ALL), v AS (SELECT zone, count(*) FILTER (n > 1) AS hours, count(*) FILTER (n > 1 AND spread > 1e-9) AS varying FROM h GROUP BY 1), s AS (SELECT zone, count(*) AS n, count(DISTINCT value) AS n_distinct FROM raw WHERE zone <> 'click' GROUP BY 1) SELECT * FROM t FULL JOIN v USING (zone) FULL JOIN s USING (zone)")
def _(spark, d):
    raw = V.raw(spark, d)
    t = quality.resolution_transitions(raw, Z, ["PT15M", "PT60M"]).select("zone", "overlapping")
    v = quality.intra_hour_variation(raw.where("zone <> 'view'"), Z).select("zone", "hours", "varying")
    return quality.summary_join(Z, t, v, quality.series_health(raw.where("zone <> 'click'"), Z).select("zone", "n", "n_distinct"))


@register("f16_zones_without", "SELECT 'nowhere' AS zone")
def _(spark, d):
    return filters.zones_without(V.raw(spark, d), spark.createDataFrame([("click",), ("nowhere",)], "zone string"))


#: Events as a raw panel with the variables and types that layouts name; some zones lack some.
LAY = """lay AS (SELECT event_type AS zone, date_trunc('day', ts) AS day, value,
  CASE user_id % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'load_forecast' WHEN 2 THEN 'generation_forecast' ELSE 'reservoir' END AS variable,
  CASE WHEN user_id % 4 = 2 THEN CASE event_id % 3 WHEN 0 THEN 'wind_onshore' WHEN 1 THEN 'wind_offshore' ELSE 'solar' END END AS psr_type
  FROM events WHERE NOT (event_type = 'view' AND user_id % 4 = 2 AND event_id % 3 = 1) AND NOT (event_type = 'error' AND user_id % 4 = 3))"""


def _layout_raw(spark, d):
    e = V.table(spark, d, "events").where("NOT (event_type = 'view' AND user_id % 4 = 2 AND event_id % 3 = 1) AND NOT (event_type = 'error' AND user_id % 4 = 3)")
    u, k = F.col("user_id") % 4, F.col("event_id") % 3
    var = F.when(u == 0, "price").when(u == 1, "load_forecast").when(u == 2, "generation_forecast").otherwise("reservoir")
    psr = F.when(u == 2, F.when(k == 0, "wind_onshore").when(k == 1, "wind_offshore").otherwise("solar"))
    return e.select(F.col("event_type").alias("zone"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "value", var.alias("variable"), psr.alias("psr_type"))


def _layout_sql(layout: str) -> str:
    cols, ns = [], []
    for n, var, codes in filters.LAYOUTS[layout]:
        cond = f"variable = '{var}'" + (f" AND psr_type IN ({', '.join(map(repr, codes))})" if codes else "")
        part = "psr_type" if codes else "''"
        cols.append(f"sum(value) FILTER ({cond}) AS s_{n}, count(DISTINCT CASE WHEN {cond} THEN {part} END) AS c_{n}")
        ns.append(f"count(DISTINCT CASE WHEN {cond} THEN {part} END) AS n_{n}")
    names = [n for n, *_ in filters.LAYOUTS[layout]]
    return f"WITH {LAY}, g AS (SELECT zone, day, {', '.join(cols)} FROM lay GROUP BY ALL), k AS (SELECT zone, {', '.join(ns)} FROM lay GROUP BY 1) SELECT zone, day, " + ", ".join(f"round(CASE WHEN c_{n} >= greatest(n_{n}, 1) THEN s_{n} END, 5) AS {n}" for n in names) + " FROM g JOIN k USING (zone)"


def _layout(layout: str):
    @register(f"f14_layout_{layout.replace('-', '_')}", _layout_sql(layout))
    def _(spark, d):
        out = filters.named_layout(_layout_raw(spark, d), layout, ["zone", "day"])
        return out.withColumns({n: F.round(n, 5) for n, *_ in filters.LAYOUTS[layout]})


for _name in filters.LAYOUTS:
    _layout(_name)


@register("j10_multi_zone_wide", f"WITH {V.HOURLY}, x AS (SELECT series, ts, value, value * 2 AS twice FROM hourly WHERE NOT (series = 'view' AND hour(ts) = 4)) SELECT ts, " + ", ".join(f"round(any_value(value) FILTER (series = '{z}'), 6) AS {z}_value, round(any_value(twice) FILTER (series = '{z}'), 6) AS {z}_twice" for z in ZONES) + " FROM x GROUP BY ts HAVING count(DISTINCT series) = 5")
def _(spark, d):
    h = V.hourly(spark, d).where("NOT (series = 'view' AND hour(ts) = 4)").withColumn("twice", F.col("value") * 2)
    out = panel.multi_zone_wide(h, ZONES, ["value", "twice"], "series")
    return r6(out, *out.columns[1:])


@register("s18_combine_predictions", f"WITH {M.MEMBERS} SELECT series AS zone, ts, round(avg(forecast), 6) AS forecast, round(max(observed), 6) AS observed FROM fc GROUP BY ALL")
def _(spark, d):
    p = M.members(spark, d).groupBy(F.col("series").alias("zone"), "ts").agg(F.avg("forecast").alias("forecast"), F.max("observed").alias("observed"))
    return r6(panel.combine_predictions([p.where(F.col("zone") == z) for z in ZONES]), "forecast", "observed")


@register("s15_mixed_kinds", f"WITH {M.MEMBERS} SELECT 'window' AS kind, count(DISTINCT member) AS members FROM fc WHERE member IN ('D', 'W')")
def _(spark, d):
    return panel.mixed_kinds(M.members(spark, d).withColumn("kind", F.when(F.col("member") == "N", "seed").otherwise("window")))


@register("e19_real_prices", f"WITH {V.HOURLY}, g AS (SELECT series, CAST(ts AS DATE) AS day, hour(ts) AS h, value FROM hourly), x AS (SELECT s.series, s.day, r.h, g.value FROM (SELECT DISTINCT series, day FROM g WHERE day(day) % 3 = 0) s, (SELECT unnest(range(24)) AS h) r LEFT JOIN g ON g.series = s.series AND g.day = s.day AND g.h = r.h) SELECT series, day, CAST(h AS INTEGER) AS h, round(value, 6) AS value FROM x")
def _(spark, d):
    h = V.hourly(spark, d)
    days = h.select(F.to_date("ts").alias("day")).where("day(day) % 3 = 0")
    return r6(evaluate.real_prices(h, ["series"], days).select("series", "day", F.posexplode("slots").alias("h", "value")), "value")


@register("e20_model_vs_model", f"WITH {M.MEMBERS} SELECT a.series, count(*) AS hours, round(avg(abs(a.observed - a.forecast)), 6) AS mae_a, round(avg(abs(a.observed - b.forecast)), 6) AS mae_b FROM fc a JOIN fc b ON a.series = b.series AND a.ts = b.ts AND a.member = 'D' AND b.member = 'W' WHERE a.slot % 5 <> 0 AND b.slot % 7 <> 0 GROUP BY 1")
def _(spark, d):
    m = M.members(spark, d)
    a = m.where("member = 'D'").withColumn("observed", F.when(F.col("slot") % 5 != 0, F.col("observed")))  # some hours unobserved
    return r6(evaluate.model_vs_model(a, m.where("member = 'W' AND slot % 7 <> 0"), ["series"], ["series", "ts"]), "mae_a", "mae_b")


@register("e7_hours_scored", f"WITH {M.MEMBERS} SELECT series, member, count(*) FILTER (slot % 5 <> 0) AS hours_scored, count(*) FILTER (slot % 5 = 0) AS hours_unobserved, round(avg(abs(observed - forecast)) FILTER (slot % 5 <> 0), 6) AS mae FROM fc GROUP BY ALL")
def _(spark, d):
    m = M.members(spark, d).withColumn("observed", F.when(F.col("slot") % 5 != 0, F.col("observed")))
    return r6(evaluate.hours_scored(m, ["series", "member"]), "mae")


@register("a6_incomplete_weeks", f"WITH {V.HOURLY}, w AS (SELECT series, (isodow(ts) - 1) * 24 + hour(ts) AS h FROM hourly WHERE NOT (series < 'p' AND isodow(ts) = 3 AND hour(ts) > 20) GROUP BY ALL) SELECT series, 168 - count(*) AS lacking FROM w GROUP BY 1 HAVING count(*) < 168")
def _(spark, d):
    h = V.hourly(spark, d).where("NOT (series < 'p' AND weekday(ts) = 2 AND hour(ts) > 20)")  # three hours of the week planted as absent
    return explore.complete_week(explore.average_week(h, ["series"]), ["series"])


STAB = "SELECT series, round(skewness({c}), 5) AS skew{s}, round(kurtosis({c}), 5) AS kurtosis{s}, round((max(s) - min(s)) / stddev_samp({c}), 5) AS rolling_range{s} FROM (SELECT series, {c}, CASE WHEN count({c}) OVER w = 168 THEN stddev_samp({c}) OVER w END AS s FROM x WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)) GROUP BY 1"


@register("a8_stabilisation_comparison", f"WITH {M.FILLED}, x AS (SELECT series, ts, value, asinh(value) AS t FROM filled), a AS ({STAB.format(c='value', s='')}), b AS ({STAB.format(c='t', s='_t')}), n AS (SELECT series, count(value) AS n FROM x GROUP BY 1) SELECT * FROM n JOIN a USING (series) JOIN b USING (series)")
def _(spark, d):
    out = explore.stabilisation_comparison(M.filled(spark, d).withColumn("t", F.asinh("value")), ["series"], "value", "t")
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c not in ("series", "n")})


@register("i1_unfilled", f"WITH {V.GRIDDED}, f AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series, (epoch(ts)::BIGINT // 3600) % 168 ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM gridded) SELECT series, count(*) AS n, min(ts) AS first FROM f WHERE filled IS NULL GROUP BY 1")
def _(spark, d):
    return impute.unfilled(impute.weekly_lag_fill(V.gridded(spark, d), ["series"]), ["series"])


@register("m10_search_window", f"WITH {V.DAILY} SELECT DATE '2000-01-01' - 728 AS begin, DATE '1999-12-31' AS \"end\", min(CAST(ts AS DATE)) AS first, DATE '2000-01-01' - 728 - min(CAST(ts AS DATE)) AS days, true AS disjoint FROM daily")
def _(spark, d):
    out = forecast.search_window(V.daily(spark, d), "2000-01-01", 2)
    return out.withColumn("days", F.col("days").cast("long"))


@register("m2_information_set", f"WITH {V.WARR}, f AS (SELECT a.zone, count(*) AS days FROM warr a JOIN warr b ON b.zone = a.zone AND b.day = a.day - 7 GROUP BY 1) SELECT zone, days, true AS blind FROM f")
def _(spark, d):
    """A day's own prices must not reach its features: changed prices of one day leave that day's features as they are."""
    w = V.wide(spark, d)
    day = w.groupBy("zone").agg(F.date_add(F.min(F.to_date("ts")), 30).alias("_day"))
    changed = w.join(day, "zone").withColumn("price", F.when(F.to_date("ts") == F.col("_day"), F.col("price") + 1e6).otherwise(F.col("price")))
    of = lambda x: features.lag_features(features.day_arrays(x, Z, COLS), Z, "price", ["load", "wind"])
    a = of(w).select("zone", "day", F.xxhash64("features").alias("fa"))
    b = of(changed.drop("_day")).select("zone", "day", F.xxhash64("features").alias("fb"))
    j = a.join(b, ["zone", "day"]).join(day, "zone")
    return j.groupBy("zone").agg(F.count("*").alias("days"), F.bool_and((F.col("day") > F.col("_day")) | (F.col("fa") == F.col("fb"))).alias("blind"))


@register("v8_no_look_ahead", f"WITH {V.GRIDDED} SELECT series, 0 AS changed, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS rows FROM gridded GROUP BY 1")
def _(spark, d):
    """Changing all values from a stamp on changes nothing that the imputation says before it."""
    g = V.gridded(spark, d)
    later = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    of = lambda x: impute.impute_cascade(x, ["series"]).where(~later).select("series", "ts", "value", "method")
    a, b = of(g), of(g.withColumn("value", F.when(later, F.col("value") * 3 + 7).otherwise(F.col("value"))))
    j = a.join(b.select("series", "ts", F.col("value").alias("vb"), F.col("method").alias("mb")), ["series", "ts"], "full_outer")
    same = F.col("value").eqNullSafe(F.col("vb")) & F.col("method").eqNullSafe(F.col("mb"))
    return j.groupBy("series").agg(F.sum((~same).cast("int")).cast("int").alias("changed"), F.count("*").alias("rows"))


@register("x3_constant_columns", f"WITH {V.DAILY}, x AS (SELECT * FROM daily UNION ALL SELECT 'flat', ts, 7.0 FROM daily), m AS (SELECT series, median(value) AS med FROM x GROUP BY 1), g AS (SELECT x.series, round(min(med), 4) AS centre, median(abs(value - med)) / 0.6744897501960817 AS mad FROM x JOIN m USING (series) GROUP BY 1) SELECT series, centre, round(CASE WHEN mad = 0 THEN 1 ELSE mad END, 4) AS spread, mad = 0 AS constant FROM g")
def _(spark, d):
    x = V.daily(spark, d)
    x = x.unionByName(x.select(F.lit("flat").alias("series"), "ts", F.lit(7.0).alias("value")))  # planted
    return scale.scaler_fit(x, ["series"], "Median").withColumns({"centre": F.round("centre", 4), "spread": F.round("spread", 4)})
