"""Queries of sources, checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import checks, features, grid
from panelcast.plans import modelling as M
from panelcast.plans import views as V
from panelcast.plans.registry import register
from panelcast.plans.views import KEY5, YEAR, ZONES, r6
from panelcast.sources import dataset, panel
from panelcast.sources.scratch import new_path
from panelcast.streaming import panel as stream

ZV = ["zone", "variable"]


@register("s1_read_raw_panel", f"WITH {V.RAW} SELECT zone, variable, count(*) AS n, max(ts) AS last FROM raw WHERE zone IN ('click', 'view') AND variable NOT IN ('load') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10 06:00:00' GROUP BY ALL")
def _(spark, d):
    path = new_path(spark, "raw")
    raw = V.raw(spark, d).withColumn("timestamp_utc", F.col("ts"))
    cols = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in panel.RAW_SCHEMA]
    panel.write_raw(raw.select(*cols), path)
    out = panel.read_raw_panel(spark, path, ["click", "view"], ["load"], "2024-01-05", "2024-01-10 05:00:00")
    return out.groupBy(*ZV).agg(F.count("*").alias("n"), F.max("timestamp_utc").alias("last"))


@register("s2_wide_csv", f"WITH {V.HOURLY} SELECT ts, " + ", ".join(f"round(max(value) FILTER (series = '{z}'), 6) AS {n}" for z, n in zip(ZONES, ["price", "exogenous_1", "exogenous_2", "exogenous_3", "exogenous_4"], strict=True)) + " FROM hourly GROUP BY ts")
def _(spark, d):
    path = new_path(spark, "wide")
    wide = V.hourly(spark, d).groupBy("ts").pivot("series", ZONES).agg(F.first("value"))
    panel.export_wide_csv(wide.withColumn("zone", F.lit("X")), path)
    out = panel.read_wide_csv(spark, f"{path}/zone=X", 4)
    return r6(out, *out.columns[1:])


@register("s3_split_by_dates", f"WITH {V.DAILY} SELECT CASE WHEN CAST(ts AS DATE) < DATE '1998-01-01' THEN false WHEN CAST(ts AS DATE) <= DATE '1999-06-30' THEN true END AS is_test, count(*) AS n, min(ts) AS first FROM daily GROUP BY 1")
def _(spark, d):
    return panel.train_test_split(V.daily(spark, d), begin="1998-01-01", end="1999-06-30").groupBy("is_test").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@register("s3_train_test_split", f"WITH {V.DAILY}, e AS (SELECT max(CAST(ts AS DATE)) AS e FROM daily) SELECT CAST(ts AS DATE) > e - 728 AS is_test, count(*) AS n, min(ts) AS first FROM daily, e GROUP BY 1")
def _(spark, d):
    return panel.train_test_split(V.daily(spark, d), 2).groupBy("is_test").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


POINTS = "p AS (SELECT event_type AS zone, CAST(ts AS DATE)::TIMESTAMP AS start, hour(ts) + 1 AS position, max(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY ALL)"


@register("s5_expand_sparse_points", f"WITH {POINTS}, g AS (SELECT zone, start, unnest(range(1, 25)) AS slot FROM (SELECT DISTINCT zone, start FROM p)), j AS (SELECT g.zone, g.start, CAST(slot AS INTEGER) AS slot, last_value(value IGNORE NULLS) OVER (PARTITION BY g.zone, g.start ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g LEFT JOIN p ON p.zone = g.zone AND p.start = g.start AND p.position = g.slot) SELECT zone, slot, start + (slot - 1) * INTERVAL 1 HOUR AS ts, value FROM j WHERE value IS NOT NULL")
def _(spark, d):
    e = V.table(spark, d, "events").where("event_id % 3 = 0")  # makes the gaps that are filled here
    p = e.groupBy(F.col("event_type").alias("zone"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), (F.hour("ts") + 1).alias("position")).agg(F.max("value").alias("value"))
    p = p.withColumns({"end": F.col("start") + F.expr("interval 1 day"), "resolution": F.lit("PT60M")})
    return panel.expand_sparse_points(p, ["zone"]).select("zone", "slot", "ts", "value")


def _documents(spark, d):
    """The hourly panel as market documents of a day each, with acknowledgements, read back."""
    path, day = new_path(spark, "documents"), F.date_trunc("day", "ts").cast("timestamp_ntz")
    h = V.hourly(spark, d).select(F.concat_ws("-", "series", F.date_format("ts", "MMdd")).alias("series"), day.alias("start"), (day + F.expr("interval 1 day")).alias("end"), F.lit("PT60M").alias("resolution"), (F.hour("ts") + 1).alias("position"), F.round("value", 6).alias("value"), F.lit("B16").alias("psr_type"), F.lit("A75").alias("business_type"), F.lit("MAW").alias("unit"))
    codes = h.select(F.substring_index("series", "-", 1).alias("s")).distinct().select(F.when(F.col("s") < "f", "999").otherwise("A01").alias("code"), F.concat(F.lit("no data for "), "s").alias("text"))
    panel.write_market_xml(h, path, codes)
    return panel.read_market_xml(spark, path)


@register("s4_market_documents", f"WITH {V.HOURLY} SELECT series || '-' || strftime(ts, '%m%d') AS series, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", 'PT60M' AS resolution, CAST(hour(ts) + 1 AS INTEGER) AS position, round(value, 6) AS value, 'B16' AS psr_type, 'A75' AS business_type, CAST(NULL AS VARCHAR) AS curve_type, 'MAW' AS unit, CAST(NULL AS VARCHAR) AS currency FROM hourly")
def _(spark, d):
    return _documents(spark, d)[0]


@register("s4_rejections", "SELECT DISTINCT 'A01' AS code, 'no data for ' || event_type AS text FROM events WHERE event_type >= 'f'")
def _(spark, d):
    return _documents(spark, d)[1]


@register("s6_collapse_publications_first", f"WITH {V.RAW} SELECT zone, ts, arg_min(value, ingest_seq) AS value FROM raw GROUP BY ALL")
def _(spark, d):
    return panel.collapse_publications(V.raw(spark, d), ["zone", "ts"], "ingest_seq")


@register("s6_collapse_publications_sum", f"WITH {V.RAW}, f AS (SELECT zone, ts, psr_type, arg_min(value, ingest_seq) AS value FROM raw GROUP BY ALL) SELECT zone, ts, round(sum(value), 6) AS value FROM f GROUP BY ALL")
def _(spark, d):
    return r6(panel.collapse_publications(V.raw(spark, d), ["zone", "ts"], "ingest_seq", "sum"), "value")


@register("s7_shape_raw", f"WITH {V.RAW} SELECT zone, 'load' AS variable, CASE WHEN ingest_seq % 3 = 0 THEN 'MWH' ELSE 'MAW' END AS unit, psr_type, ts AS timestamp_utc, value FROM raw WHERE variable = 'load'")
def _(spark, d):
    raw = V.raw(spark, d).where("variable = 'load'").withColumns({"price_unit": F.when(F.col("ingest_seq") % 3 == 0, "MWH"), "quantity_unit": F.lit("MAW")})
    return panel.shape_raw(raw, F.col("zone"), "load").select("zone", "variable", "unit", "psr_type", "timestamp_utc", "value")


@register("s8_combine_zone_parts", f"WITH {V.RAW} SELECT zone, variable, psr_type, resolution, ts AS timestamp_utc, value FROM raw")
def _(spark, d):
    path, raw = new_path(spark, "parts"), V.raw(spark, d).withColumn("timestamp_utc", F.col("ts"))
    cols = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in panel.RAW_SCHEMA]
    for z in ZONES:  # one dataset a zone, as a run over zones leaves them
        panel.write_raw(raw.where(F.col("zone") == z).select(*cols), f"{path}/{z}")
    parts = [panel.read_raw_panel(spark, f"{path}/{z}") for z in ZONES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("zone", "variable", "psr_type", "resolution", "timestamp_utc", "value")


EXPECTED = [(z, v) for z in [*ZONES, "nowhere"] for v in ("load", "price")]
EXP = "ex(zone, variable) AS (VALUES " + ", ".join(f"('{z}', '{v}')" for z, v in EXPECTED) + ")"


@register("s9_coverage_manifest", f"WITH {V.RAW}, {EXP}, g AS (SELECT zone, variable, count(*) AS rows, min(ts) AS first, max(ts) AS last, string_agg(DISTINCT resolution, ',' ORDER BY resolution) AS resolutions, coalesce(string_agg(DISTINCT psr_type, ',' ORDER BY psr_type), '') AS psr_types FROM raw GROUP BY ALL) SELECT ex.zone, ex.variable, coalesce(rows, 0) AS rows, first, last, resolutions, psr_types FROM ex LEFT JOIN g USING (zone, variable)")
def _(spark, d):
    return panel.coverage_manifest(V.raw(spark, d), spark.createDataFrame(EXPECTED, "zone string, variable string"))


@register("s10_missing_items", f"WITH {V.RAW}, {EXP} SELECT * FROM ex WHERE (zone, variable) NOT IN (SELECT (zone, variable) FROM raw WHERE zone <> 'view') AND NOT (zone = 'nowhere' AND variable = 'load')")
def _(spark, d):
    ex = spark.createDataFrame(EXPECTED, "zone string, variable string")
    answered = ex.where("zone = 'nowhere'").withColumn("error", F.when(F.col("variable") == "price", "timeout"))
    return panel.missing_items(ex, V.raw(spark, d).where("zone <> 'view'"), answered)


OLD = "a AS (SELECT zone, variable, psr_type, resolution, ts, min(value) AS value FROM raw WHERE ingest_seq % 10 < 8 GROUP BY ALL), b AS (SELECT zone, variable, psr_type, resolution, ts, max(value) AS value FROM raw WHERE ingest_seq % 10 >= 6 GROUP BY ALL)"
SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in KEY5)


def _two(spark, d):
    raw = V.raw(spark, d)
    a = raw.where("ingest_seq % 10 < 8").groupBy(*KEY5).agg(F.min("value").alias("value"))
    return a, raw.where("ingest_seq % 10 >= 6").groupBy(*KEY5).agg(F.max("value").alias("value"))


@register("s11_merge_requery", f"WITH {V.RAW}, {OLD} SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {SAME})")
def _(spark, d):
    return panel.merge_requery(*_two(spark, d), KEY5)[0]


@register("s11_conflicts", f"WITH {V.RAW}, {OLD} SELECT a.zone, a.variable, a.psr_type, a.resolution, a.ts, a.value AS kept, b.value AS fetched FROM a JOIN b ON {SAME} WHERE a.value IS DISTINCT FROM b.value")
def _(spark, d):
    return panel.merge_requery(*_two(spark, d), KEY5)[2]


@register("s11_merge_on_storage", f"WITH {V.RAW}, {OLD} SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {SAME})")
def _(spark, d):
    path, (old, new) = new_path(spark, "dataset"), _two(spark, d)
    dataset.create(old, path, ["zone", "variable"])
    dataset.merge(spark, path, new, KEY5)
    return dataset.read(spark, path).select(old.columns)


WINDOWS = [("w1", "click", "load", "2024-01-03", "2024-01-06", None), ("w2", "view", "price", "2024-01-10", "2024-01-11", "B16"), ("w3", "nowhere", "load", "2024-01-01", "2024-02-01", None)]
WIN = "wi(\"window\", zone, variable, a, b, psr) AS (VALUES " + ", ".join(f"('{n}', '{z}', '{v}', TIMESTAMP '{a}', TIMESTAMP '{b}', {repr(p) if p else 'NULL'})" for n, z, v, a, b, p in WINDOWS) + ")"


HIT = "h AS (SELECT w.\"window\", b.* FROM b JOIN wi w ON b.zone = w.zone AND b.variable = w.variable AND (w.psr IS NULL OR w.psr = b.psr_type) AND b.ts >= w.a AND b.ts < w.b), ad AS (SELECT * FROM h b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {same}))".format(same=SAME)


def _windows(spark):
    w = spark.createDataFrame(WINDOWS, "window string, zone string, variable string, start string, end string, psr_type string")
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("s12_repair_windows", f"WITH {V.RAW}, {OLD}, {WIN}, {HIT} SELECT \"window\", (SELECT count(*) FROM h WHERE h.\"window\" = wi.\"window\") AS rows_returned, (SELECT count(*) FROM ad WHERE ad.\"window\" = wi.\"window\") AS rows_added FROM wi")
def _(spark, d):
    return panel.repair_windows(*_two(spark, d), _windows(spark), KEY5)[1]


@register("s12_repaired_panel", f"WITH {V.RAW}, {OLD}, {WIN}, {HIT} SELECT * FROM a UNION ALL SELECT DISTINCT zone, variable, psr_type, resolution, ts, value FROM ad")
def _(spark, d):
    return panel.repair_windows(*_two(spark, d), _windows(spark), KEY5)[0]


@register("s12_repair_on_storage", f"WITH {V.RAW}, {OLD}, {WIN}, {HIT}, x AS (SELECT zone, variable, false AS added FROM a UNION ALL SELECT DISTINCT ON (zone, variable, psr_type, resolution, ts) zone, variable, true FROM ad) SELECT zone, variable, count(*) AS rows, bool_or(added) AS rewritten FROM x GROUP BY ALL")
def _(spark, d):
    path, (old, new) = new_path(spark, "dataset"), _two(spark, d)
    first = dataset.create(old, path, ZV)
    _, after = dataset.repair(spark, path, new, _windows(spark), KEY5)
    kept = [p for p, c in after.commits.items() if first.commits.get(p) == c]  # partitions whose files are the old ones
    name = F.concat(F.lit("zone="), "zone", F.lit("/variable="), "variable")
    return dataset.read(spark, path).groupBy(*ZV).agg(F.count("*").alias("rows")).withColumn("rewritten", ~name.isin(kept))


@register("s13_report_json", "SELECT '{\"zone\":\"' || event_type || '\",\"hours\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || ',\"span\":{\"first\":\"' || strftime(min(ts), '%Y-%m-%d') || '\",\"last\":\"' || strftime(max(ts), '%Y-%m-%d') || '\"}}' AS json FROM events GROUP BY event_type")
def _(spark, d):
    g = V.table(spark, d, "events").groupBy(F.col("event_type").alias("zone")).agg(F.count("*").alias("hours"), F.count_distinct("user_id").alias("users"), F.struct(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last")).alias("span"))
    return panel.report_json(g)


@register("s13_clean_panel_sink", f"WITH {V.GRIDDED} SELECT series, ts, round(value, 6) AS value FROM gridded")
def _(spark, d):
    path = new_path(spark, "clean")
    panel.write_clean_panel(V.gridded(spark, d), path, ["series"])
    return r6(spark.read.parquet(path).select("series", "ts", "value"), "value")


@register("s17_tidy_members", f"WITH {M.MEMBERS} SELECT series, ts, round(max(observed), 6) AS actual, " + ", ".join(f"round(max(forecast) FILTER (member = '{m}'), 6) AS \"{m}\"" for m in "DNW") + " FROM fc GROUP BY ALL")
def _(spark, d):
    return r6(panel.tidy_members(M.members(spark, d), ["series", "ts"], list("DNW")), "actual", *"DNW")


@register("s19_split_joint_forecast", f"WITH {M.ARR}, k AS (SELECT day FROM arr GROUP BY day HAVING count(*) = 5) SELECT day, series AS zone, CAST(slot AS INTEGER) AS slot, round(forecast, 6) AS forecast FROM (SELECT day, series, unnest(range(24)) AS slot, unnest(v) AS forecast FROM arr WHERE day IN (SELECT day FROM k))")
def _(spark, d):
    days = M._days(spark, d).groupBy("day").pivot("series", ZONES).agg(F.first("value")).dropna()
    return r6(panel.split_joint_forecast(days.select("day", F.concat(*ZONES).alias("joint")), ["day"], ZONES), "forecast")


@register("v1_grid_violations", f"WITH {V.HOURLY}, x AS (SELECT * FROM hourly UNION ALL SELECT series, ts, value FROM hourly WHERE day(ts) = 9 UNION ALL SELECT series, ts + INTERVAL 400 DAY, NULL FROM hourly WHERE day(ts) = 2 UNION ALL SELECT series, ts + to_minutes(CASE WHEN hour(ts) % 2 = 0 THEN 30 ELSE 45 END), value FROM hourly WHERE day(ts) = 16 AND hour(ts) % 5 < 2), p AS (SELECT series, ts, value, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS p FROM x), v AS (SELECT series, ts, CASE WHEN p = 0 THEN 'repeated' WHEN p % 3600 <> 0 THEN 'off grid' WHEN p > 3600 THEN 'gap' WHEN value IS NULL THEN 'null' END AS violation FROM p) SELECT * FROM v WHERE violation IS NOT NULL")
def _(spark, d):
    h = V.hourly(spark, d)  # with repeated stamps, stamps at :30 and :45, and nulls planted
    late = h.where("day(ts) = 2").select("series", (F.col("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(None).cast("double").alias("value"))
    odd = h.where("day(ts) = 16 AND hour(ts) % 5 < 2").withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.when(F.hour("ts") % 2 == 0, 30).otherwise(45)))
    return checks.grid_violations(h.unionByName(h.where("day(ts) = 9")).unionByName(late).unionByName(odd), ["series"], value="value")


@register("v1_whole_days", f"WITH {V.GRIDDED}, g AS (SELECT series, min(ts) AS first, max(ts) AS last, count(*) % 24 AS beyond FROM gridded WHERE NOT (series = 'view' AND hour(ts) = 23 AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM gridded)) GROUP BY 1) SELECT * FROM g WHERE hour(first) <> 0 OR hour(last) <> 23 OR beyond <> 0")
def _(spark, d):
    g = V.gridded(spark, d)
    last = g.agg(F.max(F.to_date("ts")).alias("_last"))
    g = g.crossJoin(last).where("NOT (series = 'view' AND hour(ts) = 23 AND to_date(ts) = _last)").drop("_last")  # the last hour of one series planted as absent
    return checks.whole_day_violations(g, ["series"])


@register("v2_day_violations", f"WITH {V.HOURLY}, x AS (SELECT *, CAST(ts AS DATE) AS day FROM hourly WHERE NOT (series < 'p' AND day(ts) IN (5, 6, 21))), r AS (SELECT series, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM x GROUP BY 1) SELECT r.series, r.day, count(x.ts) AS rows, count(DISTINCT x.ts) AS stamps, count(x.value) AS \"values\" FROM r LEFT JOIN x ON r.series = x.series AND r.day = x.day GROUP BY ALL HAVING count(x.ts) <> 24")
def _(spark, d):
    return checks.day_violations(V.hourly(spark, d).where("NOT (series < 'p' AND day(ts) IN (5, 6, 21))"), ["series"])  # days planted as absent


@register("v3_spring_violations", f"WITH {V.HOURLY}, {YEAR}, l AS (SELECT series, {V.CPH.format('ts')} AS local, avg(value) AS value FROM year GROUP BY ALL), g AS (SELECT series, unnest(generate_series(min(local), max(local), INTERVAL 1 HOUR)) AS local FROM l GROUP BY 1), j AS (SELECT g.series, g.local, value, timezone('Europe/Copenhagen', timezone('Europe/Copenhagen', g.local)) <> g.local AS sk FROM g LEFT JOIN l ON g.series = l.series AND g.local = l.local), w AS (SELECT *, (lag(value) OVER o + lead(value) OVER o) / 2 AS m FROM j WINDOW o AS (PARTITION BY series ORDER BY local)) SELECT series, local, round(m + CASE WHEN series < 'p' THEN 1 ELSE 0 END, 6) AS value FROM w WHERE sk AND value IS NULL AND m IS NOT NULL AND series < 'p'")
def _(spark, d):
    g = grid.fill_skipped_hours(grid.to_local_grid(V.spring(spark, d), ["series"], "Europe/Copenhagen"), ["series"], "Europe/Copenhagen")
    wrong = (F.col("dst_adjustment") == "spring_interpolation") & (F.col("series") < "p")  # planted: some zones' filled hours are off by one
    g = g.withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value")))
    return r6(checks.spring_violations(g, ["series"], "Europe/Copenhagen"), "value")


@register("v4_load_guards", f"WITH {V.RAW}, h AS (SELECT zone, psr_type, date_trunc('hour', ts) AS hour, bool_or(resolution = 'PT60M') AS hourly, max(value) - min(value) AS spread FROM raw WHERE variable = 'price' GROUP BY ALL) SELECT 'zone absent' AS guard, 'nowhere' AS detail UNION ALL SELECT DISTINCT 'variable excluded', variable FROM raw WHERE variable = 'load' UNION ALL SELECT 'before start', CAST(min(ts) AS VARCHAR) FROM raw HAVING min(ts) < TIMESTAMP '2024-01-02' UNION ALL SELECT 'after end', CAST(max(ts) AS VARCHAR) FROM raw HAVING max(ts) >= TIMESTAMP '2024-01-29 01:00:00' UNION ALL SELECT DISTINCT 'product', resolution FROM raw WHERE zone = 'click' AND variable = 'price' AND resolution <> 'PT60M' UNION ALL SELECT 'quarters differ', zone || ' ' || count(*) FROM h WHERE NOT hourly AND spread > 0 GROUP BY zone")
def _(spark, d):
    return checks.load_guards(V.raw(spark, d), [*ZONES, "nowhere"], ["load"], "2024-01-02", "2024-01-29", ("click", "price", "PT60M"))


@register("v6_run_checks", f"WITH {V.WARR}, f AS (SELECT a.zone, count(*) AS fd, min(a.day) AS f1 FROM warr a JOIN warr b ON a.zone = b.zone AND b.day = a.day - 7 GROUP BY 1), n AS (SELECT zone, count(*) AS days, min(day) AS first FROM warr GROUP BY 1), e AS (SELECT count(DISTINCT day) AS every FROM warr), x AS (SELECT * FROM n JOIN f USING (zone), e) SELECT zone, 'layout' AS name, true AS passed, '3' AS detail FROM x UNION ALL SELECT zone, 'features', true, '247 247' FROM x UNION ALL SELECT zone, 'test days', fd >= 728, CAST(fd AS VARCHAR) FROM x UNION ALL SELECT zone, 'burn-in', f1 - first >= 8, CAST(f1 - first AS VARCHAR) FROM x UNION ALL SELECT zone, 'days', days = every, days || ' ' || every FROM x")
def _(spark, d):
    w = V.wide(spark, d)
    x = features.lag_features(features.day_arrays(w, ["zone"], ["price", "load", "wind"]), ["zone"], "price", ["load", "wind"])
    return checks.run_checks(w, x, ["price", "load", "wind"], 247, 728, 8)


@register("v6_preflight", f"WITH {V.HOURLY} SELECT 'series' AS name, count(DISTINCT series) = 5 AS passed, CAST(count(DISTINCT series) AS VARCHAR) AS detail FROM hourly UNION ALL SELECT 'no nulls', count(*) = count(value), CAST(count(*) - count(value) AS VARCHAR) FROM hourly")
def _(spark, d):
    n, k = F.count_distinct("series"), F.count("*") - F.count("value")
    return checks.preflight(V.hourly(spark, d), {"series": (n == 5, n), "no nulls": (k == 0, k)})


@register("v7_misaligned", f"WITH {V.GRIDDED} SELECT g.series, g.ts, 'second' AS only_in FROM gridded g LEFT JOIN hourly h ON h.series = g.series AND h.ts = g.ts WHERE h.ts IS NULL")
def _(spark, d):
    return checks.misaligned(V.hourly(spark, d), V.gridded(spark, d), ["series", "ts"])


@register("v9_smeared_hours", f"WITH {V.RAW} SELECT zone, variable, date_trunc('hour', ts) AS hour, round(max(value) - min(value), 6) AS spread FROM raw WHERE resolution = 'PT15M' GROUP BY ALL HAVING max(value) - min(value) > 1e-9")
def _(spark, d):
    return r6(checks.smeared_hours(V.raw(spark, d).where("resolution = 'PT15M'"), ZV), "spread")


def _events(spark, d):
    return stream.read_events(spark, f"{d}/events.parquet")


@register("t1_stream_hourly_collapse", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value, count(value) AS slots FROM events GROUP BY ALL) SELECT * FROM h WHERE hour + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events)")
def _(spark, d):
    out = stream.run_once(stream.hourly_collapse(_events(spark, d), ["event_type"]))
    return r6(out.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "value")


@register("t2_stream_dedupe", "SELECT event_id, user_id FROM events")
def _(spark, d):
    e = _events(spark, d)
    return stream.run_once(stream.dedupe(e.unionByName(_events(spark, d)), ["event_id"]).select("event_id", "user_id"))


@register("t6_stream_sessions", "WITH g AS (SELECT event_type, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stalled_at, count(*) AS rows FROM s GROUP BY event_type, s HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events)")
def _(spark, d):
    out = stream.run_once(stream.sessions(_events(spark, d), ["event_type"], gap="2 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stalled_at")})


@register("t6_stalled_runs", "WITH g AS (SELECT event_type, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS ended_at, count(*) AS rows, s = max(s) OVER (PARTITION BY event_type) AS stalled FROM s GROUP BY event_type, s")
def _(spark, d):
    out = stream.run_until_forgotten(stream.stalled_runs(_events(spark, d), "event_type", gap=7200, wait=3))  # the table's end is a source that stops
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "ended_at")})


@register("t7_stream_rolling_week", "WITH w AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS \"end\" FROM events) SELECT event_type, \"end\", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM w WHERE \"end\" + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL")
def _(spark, d):
    out = stream.run_once(stream.rolling_week(_events(spark, d), ["event_type"], slide="1 day"))
    return r6(out.withColumn("end", F.col("end").cast("timestamp_ntz")), "mean", "std")


@register("t3_stream_insert_only_merge", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'conflict' ELSE 'added' END AS outcome FROM events WHERE event_id % 4 <> 1")
def _(spark, d):
    e = V.table(spark, d, "events")
    base = e.where("event_id % 4 < 2").select("event_id", F.when(F.col("event_id") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    merged, conflicts = new_path(spark, "merged"), new_path(spark, "conflicts")
    q = _events(spark, d).select("event_id", "value").writeStream.foreachBatch(stream.insert_only_merge(base, ["event_id"], merged, conflicts))
    q.option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    added = stream.merged_rows(spark, merged, base).select("event_id", F.lit("added").alias("outcome"))
    return added.unionByName(spark.read.parquet(conflicts).select("event_id", F.lit("conflict").alias("outcome")))


@register("t3_stream_merge_by_day", "WITH b AS (SELECT event_type, ts, min(value) AS value FROM events WHERE event_id % 7 = 0 GROUP BY ALL), f AS (SELECT event_type, ts, value, event_id FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_type, ts, value + 1, event_id FROM events WHERE event_id % 7 = 0 AND event_id % 2 = 0) SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(sum(CAST(conflict AS INT)) AS BIGINT) AS conflicts FROM (SELECT ts, false AS conflict FROM b UNION ALL SELECT f.ts, false FROM (SELECT DISTINCT event_type, ts FROM f) f ANTI JOIN b USING (event_type, ts) UNION ALL SELECT ts, true FROM (SELECT DISTINCT f.event_type, f.ts, f.value FROM f JOIN (SELECT event_type, ts, arg_min(value, (src, value)) AS value FROM (SELECT 0 AS src, * FROM b UNION ALL SELECT 1, event_type, ts, value FROM f) GROUP BY ALL) k USING (event_type, ts) WHERE f.value <> k.value)) GROUP BY ALL")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_type", "ts", "value", "event_id")
    key = ["event_type", "ts"]
    base = e.where("event_id % 7 = 0").groupBy(*key).agg(F.min("value").alias("value"))
    feed = e.where("event_id % 7 <> 0").unionByName(e.where("event_id % 7 = 0 AND event_id % 2 = 0").withColumn("value", F.col("value") + 1))
    path, merged, conflicts = new_path(spark, "feed"), new_path(spark, "merged"), new_path(spark, "conflicts")
    feed.select(*key, "value").repartitionByRange(3, "ts").write.parquet(path)  # three files, a batch each
    merge = stream.insert_only_merge(base, key, merged, conflicts, part=F.to_date("ts"))
    q = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(merge)
    q.option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rows = base.unionByName(stream.merged_rows(spark, merged, base)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"))
    met = spark.read.parquet(conflicts).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("conflicts"))
    return rows.join(met, "day", "left").na.fill(0, ["conflicts"]).withColumn("rows", F.col("rows") + F.col("conflicts"))


@register("t4_stream_running_mae", "SELECT event_type, round(avg(abs(value * 0.25)), 6) AS mae, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    f = _events(spark, d).select("event_type", "event_id", "ts", (F.col("value") * 1.25).alias("forecast"))
    o = _events(spark, d).select("event_type", "event_id", "ts", F.col("value").alias("observed"))
    return r6(stream.latest(stream.run_once(stream.running_mae(f, o, ["event_type", "event_id"], ["event_type"])), ["event_type"], "n"), "mae")


@register("t5_stream_step_hold", "SELECT event_type, ts, last_value(CASE WHEN event_id % 10 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM events")
def _(spark, d):
    e = _events(spark, d).select("event_type", "ts", F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("level"), "event_id")
    out = stream.run_once(stream.step_hold(e, "event_type", seq="event_id"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
