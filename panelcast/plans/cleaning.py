"""Queries of filters, grids, audits and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import filters, grid, impute, quality
from panelcast.plans import views as V
from panelcast.plans.registry import register
from panelcast.plans.views import CPH, KEY5, YEAR, ZONES, r6

S = ["zone", "variable", "psr_type"]


@register("f1_canonical_keys", f"WITH {V.RAW} SELECT zone, variable, coalesce(psr_type, '') AS psr_type, count(*) AS n FROM raw GROUP BY ALL")
def _(spark, d):
    return filters.canonical_keys(V.raw(spark, d), S).groupBy(*S).agg(F.count("*").alias("n"))


@register("f2_decode_psr", f"WITH {V.RAW} SELECT CASE psr_type WHEN 'B16' THEN 'Solar' WHEN 'B18' THEN 'Wind Offshore' ELSE psr_type END AS psr_name, count(*) AS n FROM raw GROUP BY ALL")
def _(spark, d):
    return V.raw(spark, d).select(filters.decode(F.col("psr_type"), filters.PSR_NAMES).alias("psr_name")).groupBy("psr_name").agg(F.count("*").alias("n"))


@register("f3_series_key", f"WITH {V.RAW} SELECT zone || ' | ' || variable || CASE WHEN coalesce(psr_type, '') <> '' THEN ' [' || psr_type || ']' ELSE '' END AS series, min(ts) AS first FROM raw GROUP BY ALL")
def _(spark, d):
    return V.raw(spark, d).groupBy(filters.series_key(F.col("zone"), F.col("variable"), F.col("psr_type")).alias("series")).agg(F.min("ts").alias("first"))


@register("f4_exclude_product", f"WITH {V.RAW} SELECT zone, variable, resolution, count(*) AS n FROM raw WHERE NOT (zone = 'click' AND variable = 'price' AND resolution = 'PT15M') GROUP BY ALL")
def _(spark, d):
    return filters.exclude_product(V.raw(spark, d), zone="click", variable="price", resolution="PT15M").groupBy("zone", "variable", "resolution").agg(F.count("*").alias("n"))


@register("f5_local_window", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-04 23:00:00' AND ts < TIMESTAMP '2024-01-09 23:00:00'")
def _(spark, d):
    return V.table(spark, d, "events").where(filters.local_window(F.col("ts"), "2024-01-05", "2024-01-10", "Europe/Copenhagen")).select("event_id", "ts")


@register("f6_filter_psr", f"WITH {V.RAW} SELECT zone, count(*) AS n FROM raw WHERE psr_type IN ('B16') GROUP BY zone")
def _(spark, d):
    return filters.filter_psr(V.raw(spark, d), "B16").groupBy("zone").agg(F.count("*").alias("n"))


@register("f7_prefer_contract", f"WITH {V.RAW}, h AS (SELECT *, bool_or(resolution = 'PT60M') OVER (PARTITION BY zone, date_trunc('hour', ts)) AS has FROM raw) SELECT zone, variable, count(*) AS n, round(sum(value), 4) AS total FROM h WHERE NOT has OR resolution = 'PT60M' GROUP BY ALL")
def _(spark, d):
    raw = V.raw(spark, d).withColumn("hour", grid.hour_of(F.col("ts")))
    out = filters.prefer_contract(raw, ["zone", "hour"], "PT60M", "resolution")
    return out.groupBy("zone", "variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("f8_drop_zones", f"WITH {V.RAW} SELECT zone, count(*) AS n FROM raw WHERE zone IN ('click', 'error', 'view') AND zone NOT IN ('error') GROUP BY zone")
def _(spark, d):
    dim = spark.createDataFrame([("click",), ("error",), ("view",)], "zone string")
    return filters.drop_zones(V.raw(spark, d), dim, ["error"]).groupBy("zone").agg(F.count("*").alias("n"))


@register("f9_drop_series", f"WITH {V.RAW} SELECT zone, variable, count(*) AS n FROM raw WHERE NOT (zone = 'click' AND variable = 'load') AND NOT (zone = 'view' AND variable = 'price') GROUP BY ALL")
def _(spark, d):
    out = spark.createDataFrame([("click", "load"), ("view", "price")], "zone string, variable string")
    return filters.drop_series(V.raw(spark, d), out).groupBy("zone", "variable").agg(F.count("*").alias("n"))


@register("f10_drop_near_constant", "WITH s AS (SELECT l_suppkey, l_partkey % 10 AS k, CASE WHEN l_linenumber > 1 THEN 0 ELSE l_tax END AS v FROM lineitem), z AS (SELECT k, l_suppkey FROM s GROUP BY ALL HAVING avg(CASE WHEN abs(v) < 1e-9 THEN 1.0 ELSE 0.0 END) * 100 <= 90) SELECT k, l_suppkey, count(*) AS n FROM s JOIN z USING (k, l_suppkey) GROUP BY ALL")
def _(spark, d):
    s = V.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 10).alias("k"), F.when(F.col("l_linenumber") > 1, 0.0).otherwise(F.col("l_tax")).alias("value"))
    return filters.drop_near_constant(s, ["k", "l_suppkey"]).groupBy("k", "l_suppkey").agg(F.count("*").alias("n"))


@register("f11_drop_late_series", "WITH f AS (SELECT o_custkey, min(o_orderdate) AS a, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM f WHERE a <= TIMESTAMP '1996-01-01'")
def _(spark, d):
    o = V.table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    return filters.drop_late_series(o, ["o_custkey"], F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("f12_truncate", "SELECT event_type, count(*) AS n, max(ts) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def _(spark, d):
    e = filters.truncate_at(V.table(spark, d, "events"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return filters.trim_start(e, F.lit("2024-01-05").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@register("f13_with_unit", "SELECT l_returnflag, min(l_linestatus) || '/' || 'MW' AS unit, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    x = V.table(spark, d, "lineitem").withColumn("measure", F.lit("MAW"))
    return filters.with_unit(x, ["l_returnflag"], "l_linestatus", "measure").groupBy("l_returnflag", "unit").agg(F.count("*").alias("n"))


LAYOUT = {"price": ("price", ()), "solar": ("load", ("B16",)), "wind": ("load", ("B16", "B18"))}


@register("f14_project_layout", f"WITH {V.RAW} SELECT zone, date_trunc('hour', ts) AS hour, round(sum(value) FILTER (variable = 'price'), 6) AS price, round(sum(value) FILTER (variable = 'load' AND psr_type = 'B16'), 6) AS solar, round(sum(value) FILTER (variable = 'load' AND psr_type IN ('B16', 'B18')), 6) AS wind FROM raw GROUP BY ALL")
def _(spark, d):
    raw = V.raw(spark, d).withColumn("hour", grid.hour_of(F.col("ts")))
    return r6(filters.project_layout(raw, LAYOUT, ["zone", "hour"]), *LAYOUT)


@register("f15_component_sum", f"WITH {V.RAW}, h AS (SELECT zone, date_trunc('day', ts) AS day, psr_type, sum(value) AS v FROM raw WHERE psr_type IS NOT NULL GROUP BY ALL), n AS (SELECT zone, count(DISTINCT psr_type) AS n FROM h GROUP BY 1) SELECT h.zone, day, round(CASE WHEN count(v) >= min(n) THEN sum(v) END, 6) AS total FROM h JOIN n USING (zone) GROUP BY h.zone, day")
def _(spark, d):
    raw = V.raw(spark, d).where("psr_type IS NOT NULL").groupBy("zone", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "psr_type").agg(F.sum("value").alias("value"))
    return r6(filters.component_sum(raw, ["zone", "day"], "psr_type"), "total")


@register("f16_missing_components", f"WITH {V.RAW}, w AS (SELECT * FROM (VALUES ('click', 'load', 'B16'), ('click', 'load', 'B01'), ('nowhere', 'price', 'B18')) t(zone, variable, psr_type)) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM raw WHERE raw.zone = w.zone AND raw.variable = w.variable AND raw.psr_type = w.psr_type)")
def _(spark, d):
    w = spark.createDataFrame([("click", "load", "B16"), ("click", "load", "B01"), ("nowhere", "price", "B18")], "zone string, variable string, psr_type string")
    return filters.missing_components(V.raw(spark, d), w)


@register("f17_panel_zones", f"WITH {V.RAW} SELECT zone, bool_or(variable = 'price') AS has_variable FROM raw GROUP BY 1")
def _(spark, d):
    return filters.panel_zones(V.raw(spark, d), "price")


HOURS = "h AS (SELECT zone, variable, resolution, date_trunc('hour', ts) AS hour, avg(value) AS value, count(value) AS slots, max(CASE resolution WHEN 'PT15M' THEN 4 ELSE 1 END) AS expected_slots FROM raw GROUP BY ALL)"


def _hours(spark, d):
    return grid.collapse_to_hour(V.raw(spark, d), ["zone", "variable", "resolution"], expected=F.when(F.col("resolution") == "PT15M", 4).otherwise(1))


@register("g1_collapse_to_hour", f"WITH {V.RAW}, {HOURS} SELECT * REPLACE (round(value, 6) AS value), slots < expected_slots AS partial FROM h")
def _(spark, d):
    return r6(_hours(spark, d), "value")


@register("g2_resolution_precedence", f"WITH {V.RAW}, {HOURS} SELECT zone, variable, hour, resolution, round(value, 6) AS value, slots FROM h QUALIFY row_number() OVER (PARTITION BY zone, variable, hour ORDER BY resolution DESC) = 1")
def _(spark, d):
    out = grid.resolution_precedence(_hours(spark, d), ["zone", "variable", "hour"], ["PT60M", "PT15M"])
    return r6(out.select("zone", "variable", "hour", "resolution", "value", "slots"), "value")


@register("g3_fold_if_constant", f"WITH {V.RAW}, h AS (SELECT zone, date_trunc('hour', ts) AS hour, arg_min(value, (ts, value)) AS value, max(value) - min(value) AS spread FROM raw WHERE resolution = 'PT15M' GROUP BY ALL), f AS (SELECT zone, min(hour) FILTER (spread > 1e-9) AS first_varying FROM h GROUP BY 1) SELECT zone, hour, first_varying FROM h JOIN f USING (zone)")
def _(spark, d):
    folded, first = grid.fold_if_constant(V.raw(spark, d).where("resolution = 'PT15M'"), ["zone"])
    return folded.join(first, "zone").select("zone", "hour", "first_varying")


@register("g4_first_non_hourly", f"WITH {V.RAW} SELECT zone, variable, min(ts) FILTER (resolution <> 'PT60M') AS first_non_hourly FROM raw GROUP BY ALL")
def _(spark, d):
    return grid.first_non_hourly(V.raw(spark, d), ["zone", "variable"])


@register("g5_global_cutoff", f"WITH {V.RAW}, z AS (SELECT zone, max(ts) AS last FROM raw GROUP BY 1) SELECT *, min(last) OVER () AS cutoff FROM z")
def _(spark, d):
    return grid.global_cutoff(V.raw(spark, d), "zone", ["variable"])


@register("g6_truncate_before_variation", f"WITH {V.RAW}, h AS (SELECT zone, psr_type, variable, date_trunc('hour', ts) AS hour, max(value) - min(value) AS spread FROM raw GROUP BY ALL), f AS (SELECT zone, psr_type, variable, min(hour) FILTER (spread > 1e-9) AS fv FROM h GROUP BY ALL) SELECT h.zone, h.variable, count(*) AS n FROM h JOIN f ON h.zone = f.zone AND h.variable = f.variable AND h.psr_type = f.psr_type WHERE fv IS NULL OR hour < date_trunc('day', fv) GROUP BY ALL")
def _(spark, d):
    out = grid.truncate_before_variation(V.raw(spark, d), S)
    return out.groupBy("zone", "variable").agg(F.count("*").alias("n"))


@register("g7_complete_grid", f"WITH {V.GRIDDED} SELECT series, ts, round(value, 6) AS value FROM gridded")
def _(spark, d):
    return r6(V.gridded(spark, d), "value")


@register("g8_missing_hours", f"WITH {V.GRIDDED} SELECT series, ts FROM gridded WHERE value IS NULL")
def _(spark, d):
    return grid.missing_hours(V.hourly(spark, d), ["series"], "ts")


@register("g9_to_local_grid", f"WITH {V.HOURLY}, {YEAR}, l AS (SELECT series, {CPH.format('ts')} AS local, avg(value) AS value, count(*) AS n_utc FROM year GROUP BY ALL), g AS (SELECT series, unnest(generate_series(min(local), max(local), INTERVAL 1 HOUR)) AS local FROM l GROUP BY 1) SELECT g.series, g.local, round(value, 6) AS value, n_utc FROM g LEFT JOIN l ON g.series = l.series AND g.local = l.local")
def _(spark, d):
    return r6(grid.to_local_grid(V.spring(spark, d), ["series"], "Europe/Copenhagen"), "value")


BY_ZONE = "tz AS (SELECT series, ts, value, CASE WHEN series < 'f' THEN 'Europe/Helsinki' ELSE 'Europe/Copenhagen' END AS tz FROM year), l AS (SELECT series, tz, timezone(tz, timezone('UTC', ts)) AS local, avg(value) AS value, count(*) AS n_utc FROM tz GROUP BY ALL), g AS (SELECT series, tz, unnest(generate_series(min(local), max(local), INTERVAL 1 HOUR)) AS local FROM l GROUP BY series, tz), j AS (SELECT g.*, value, n_utc, timezone(g.tz, timezone(g.tz, g.local)) <> g.local AS sk FROM g LEFT JOIN l ON g.series = l.series AND g.local = l.local), w AS (SELECT *, (lag(value) OVER o + lead(value) OVER o) / 2 AS m FROM j WINDOW o AS (PARTITION BY series ORDER BY local))"


@register("g11_local_hours_by_zone", f"WITH {V.HOURLY}, {YEAR}, {BY_ZONE} SELECT series, tz, local, round(CASE WHEN value IS NULL AND sk THEN m ELSE value END, 6) AS value, CASE WHEN value IS NULL AND sk AND m IS NOT NULL THEN 'spring_interpolation' WHEN coalesce(n_utc, 1) > 1 THEN 'autumn_average' ELSE 'none' END AS dst_adjustment FROM w")
def _(spark, d):
    x = V.spring(spark, d).withColumn("tz", F.when(F.col("series") < "f", "Europe/Helsinki").otherwise("Europe/Copenhagen"))
    keys, tz = ["series", "tz"], F.col("tz")
    return r6(grid.fill_skipped_hours(grid.to_local_grid(x, keys, tz), keys, tz).drop("n_utc"), "value")


@register("g10_skipped_hours", f"WITH {V.HOURLY}, {YEAR}, l AS (SELECT DISTINCT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS local FROM year) SELECT local FROM l WHERE timezone('Europe/Copenhagen', timezone('Europe/Copenhagen', local)) <> local")
def _(spark, d):
    g = grid.complete_grid(V.spring(spark, d), [], "ts").withColumnRenamed("ts", "local")
    return g.where(grid.is_skipped(F.col("local"), "Europe/Copenhagen"))


@register("g11_fill_skipped_hours", f"WITH {V.HOURLY}, {YEAR}, l AS (SELECT series, {CPH.format('ts')} AS local, avg(value) AS value, count(*) AS n_utc FROM year GROUP BY ALL), g AS (SELECT series, unnest(generate_series(min(local), max(local), INTERVAL 1 HOUR)) AS local FROM l GROUP BY 1), j AS (SELECT g.series, g.local, value, n_utc FROM g LEFT JOIN l ON g.series = l.series AND g.local = l.local), w AS (SELECT *, (lag(value) OVER o + lead(value) OVER o) / 2 AS m, timezone('Europe/Copenhagen', timezone('Europe/Copenhagen', local)) <> local AS sk FROM j WINDOW o AS (PARTITION BY series ORDER BY local)) SELECT series, local, round(CASE WHEN value IS NULL AND sk THEN m ELSE value END, 6) AS value, CASE WHEN value IS NULL AND sk AND m IS NOT NULL THEN 'spring_interpolation' WHEN coalesce(n_utc, 1) > 1 THEN 'autumn_average' ELSE 'none' END AS dst_adjustment FROM w")
def _(spark, d):
    g = grid.to_local_grid(V.spring(spark, d), ["series"], "Europe/Copenhagen")
    return r6(grid.fill_skipped_hours(g, ["series"], "Europe/Copenhagen").drop("n_utc"), "value")


@register("g12_interpolate_gaps", f"WITH {V.GRIDDED}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS n FROM gridded), p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER a AS nn, last_value(value IGNORE NULLS) OVER b AS pv, first_value(value IGNORE NULLS) OVER a AS nv FROM n WINDOW b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), f AS (SELECT series, ts, coalesce(value, CASE WHEN nn - pn - 1 <= 1 THEN pv + (nv - pv) * (n - pn) / (nn - pn) END) AS value FROM p) SELECT series, ts, round(value, 6) AS value, value IS NULL AS violation FROM f")
def _(spark, d):
    return r6(grid.interpolate_gaps(V.gridded(spark, d), ["series"], "ts", max_gap=1), "value")


@register("g14_day_matrix", f"WITH {V.HOURLY}, g AS (SELECT series, CAST(ts AS DATE) AS day, hour(ts) AS h, value FROM hourly), x AS (SELECT s.series, s.day, r.h, g.value FROM (SELECT DISTINCT series, day FROM g) s, (SELECT unnest(range(24)) AS h) r LEFT JOIN g ON g.series = s.series AND g.day = s.day AND g.h = r.h) SELECT series, day, list(round(value, 6) ORDER BY h) AS slots FROM x GROUP BY series, day")
def _(spark, d):
    m = grid.day_matrix(V.hourly(spark, d), ["series"], "ts")
    return m.withColumn("slots", F.transform("slots", lambda x: V.rounded(x, 6)))


@register("g15_flatten_day_matrix", f"WITH {V.HOURLY} SELECT series, ts, round(value, 6) AS value FROM hourly")
def _(spark, d):
    return r6(grid.flatten_day_matrix(grid.day_matrix(V.hourly(spark, d), ["series"], "ts"), ["series"]).where("value IS NOT NULL"), "value")


@register("g16_step_hold", f"WITH {V.GRIDDED}, w AS (SELECT series, date_trunc('week', ts) + INTERVAL 7 DAY AS ts, max(value) AS level FROM hourly GROUP BY ALL) SELECT g.series, g.ts, round(w.level, 6) AS level FROM gridded g ASOF LEFT JOIN w ON g.series = w.series AND g.ts >= w.ts")
def _(spark, d):
    h = V.hourly(spark, d)
    weekly = h.groupBy("series", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.max("value").alias("level"))
    return r6(grid.step_hold(V.gridded(spark, d), weekly, ["series"], "ts", "week", "level", "7 days"), "level")


@register("g17_snap_weekly", f"SELECT DISTINCT ts, timezone('UTC', timezone('Europe/Copenhagen', date_trunc('day', {CPH.format('ts')} + INTERVAL 12 HOUR))) AS snapped FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("ts", grid.snap_weekly(F.col("ts"), "Europe/Copenhagen").alias("snapped")).distinct()


AUDIT = "a AS (SELECT zone, variable, psr_type, resolution, ts, count(*) AS copies, count(DISTINCT value) AS distinct_values, max(value) - min(value) AS spread FROM raw GROUP BY ALL HAVING count(*) > 1)"


@register("q1_duplicate_audit", f"WITH {V.RAW}, {AUDIT} SELECT * REPLACE (round(spread, 6) AS spread) FROM a")
def _(spark, d):
    return r6(quality.duplicate_audit(V.raw(spark, d), KEY5), "spread")


@register("q1_duplicates_by_series", f"WITH {V.RAW}, {AUDIT} SELECT zone, variable, psr_type, count(*) AS stamps, CAST(sum(copies - 1) AS BIGINT) AS redundant, CAST(sum(CASE WHEN distinct_values > 1 THEN 1 ELSE 0 END) AS BIGINT) AS disagreeing, round(max(spread), 6) AS max_spread, min(ts) AS first, max(ts) AS last FROM a GROUP BY ALL")
def _(spark, d):
    return r6(quality.duplicates_by_series(quality.duplicate_audit(V.raw(spark, d), KEY5), S, "ts"), "max_spread")


@register("q1_conflicts_top20", f"WITH {V.RAW}, {AUDIT} SELECT zone, variable, ts, round(spread, 6) AS spread FROM a ORDER BY round(spread, 6) DESC, zone, variable, ts, psr_type, resolution LIMIT 20")
def _(spark, d):
    a = r6(quality.duplicate_audit(V.raw(spark, d), KEY5), "spread")
    return a.orderBy(F.desc("spread"), "zone", "variable", "ts", F.asc_nulls_last("psr_type"), "resolution").limit(20).select("zone", "variable", "ts", "spread")


@register("q2_dedupe", f"WITH {V.RAW} SELECT zone, variable, psr_type, resolution, ts, value, ingest_seq FROM raw QUALIFY row_number() OVER (PARTITION BY zone, variable, psr_type, resolution, ts ORDER BY ingest_seq, value) = 1")
def _(spark, d):
    return quality.dedupe(V.raw(spark, d), KEY5, "ingest_seq", "value")


@register("q3_intra_hour_variation", f"WITH {V.RAW}, h AS (SELECT zone, variable, date_trunc('hour', ts) AS hour, count(*) AS n, max(value) - min(value) AS spread, max(abs(value)) AS top FROM raw WHERE resolution = 'PT15M' GROUP BY ALL HAVING count(*) > 1) SELECT zone, variable, count(*) AS hours, count(*) FILTER (spread > 1e-9) AS varying, count(*) FILTER (top <= 1e-9) AS inactive, round(max(spread), 6) AS max_spread, min(hour) AS first, max(hour) AS last, min(hour) FILTER (spread > 1e-9) AS first_varying, round(100.0 * count(*) FILTER (spread > 1e-9) / count(*), 6) AS pct_varying, round(100.0 * count(*) FILTER (spread > 1e-9) / nullif(count(*) - count(*) FILTER (top <= 1e-9), 0), 6) AS pct_of_active FROM h GROUP BY ALL")
def _(spark, d):
    return r6(quality.intra_hour_variation(V.raw(spark, d).where("resolution = 'PT15M'"), ["zone", "variable"]), "max_spread", "pct_varying", "pct_of_active")


@register("q4_monthly_variation_share", "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, max(value) - min(value) AS spread FROM events GROUP BY ALL) SELECT strftime(hour, '%Y-%m') AS month, " + ", ".join(f"round(avg(CASE WHEN spread > 1e-9 THEN 1.0 ELSE 0.0 END) FILTER (event_type = '{z}'), 6) AS {z}" for z in ZONES) + " FROM h GROUP BY 1")
def _(spark, d):
    e = V.table(spark, d, "events")
    return r6(quality.monthly_variation_share(e, "event_type", ZONES), *ZONES)


@register("q5_sustained_switch_day", "WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS hour, max(value) - min(value) AS spread FROM events GROUP BY ALL), s AS (SELECT series, CAST(hour AS DATE) AS day, avg(CASE WHEN spread > 1e-9 THEN 1.0 ELSE 0.0 END) AS share FROM h GROUP BY ALL), w AS (SELECT *, min(share) OVER o AS m, count(*) OVER o AS n FROM s WINDOW o AS (PARTITION BY series ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT series, min(day) FILTER (m >= 0.5 AND n >= 3) AS switch_day, min(day) AS first_day FROM w GROUP BY 1")
def _(spark, d):
    h = V.table(spark, d, "events").groupBy(F.col("event_type").alias("series"), grid.hour_of(F.col("ts")).alias("hour")).agg((F.max("value") - F.min("value")).alias("spread"))
    s = h.groupBy("series", F.to_date("hour").alias("day")).agg(F.avg((F.col("spread") > 1e-9).cast("double")).alias("share"))
    return quality.sustained_switch_day(s, ["series"])


@register("q6_resolution_transitions", f"WITH {V.RAW}, p AS (SELECT zone, ts, count(DISTINCT resolution) AS k, count(*) FILTER (resolution = 'PT15M') AS a, count(*) FILTER (resolution = 'PT60M') AS b FROM raw GROUP BY ALL) SELECT zone, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS overlapping, CAST(sum(a) AS BIGINT) AS \"n_PT15M\", min(ts) FILTER (a > 0) AS \"first_PT15M\", max(ts) FILTER (a > 0) AS \"last_PT15M\", CAST(sum(b) AS BIGINT) AS \"n_PT60M\", min(ts) FILTER (b > 0) AS \"first_PT60M\", max(ts) FILTER (b > 0) AS \"last_PT60M\" FROM p GROUP BY 1")
def _(spark, d):
    return quality.resolution_transitions(V.raw(spark, d), ["zone"], ["PT15M", "PT60M"])


@register("q7_resolution_overlap", f"WITH {V.RAW}, h AS (SELECT zone, date_trunc('hour', ts) AS hour, avg(value) FILTER (resolution = 'PT15M') AS a, avg(value) FILTER (resolution = 'PT60M') AS b FROM raw GROUP BY ALL) SELECT zone, count(*) AS hours, count(*) FILTER (abs(a - b) > 1e-9) AS differing, round(max(abs(a - b)), 6) AS max_diff, round(median(abs(a - b)), 6) AS median_diff FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def _(spark, d):
    return r6(quality.resolution_overlap(V.raw(spark, d), ["zone"], "PT15M", "PT60M"), "max_diff", "median_diff")


@register("q8_series_health", f"WITH {V.GRIDDED}, s AS (SELECT DISTINCT series, value FROM gridded WHERE value IS NOT NULL), t AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY value) AS st FROM s), m AS (SELECT series, min(st) AS min_step FROM t GROUP BY 1) SELECT g.series, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(100 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pct_null, round(100 * avg(CASE WHEN abs(value) < 1e-9 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 6) AS pct_zero FROM gridded g JOIN m USING (series) GROUP BY 1")
def _(spark, d):
    return r6(quality.series_health(V.gridded(spark, d), ["series"]).select("series", "n", "mean", "max", "pct_null", "pct_zero"), "mean", "max", "pct_null", "pct_zero")


COVER = "c AS (SELECT series, min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS observed, date_diff('hour', min(ts), max(ts)) + 1 AS hours FROM hourly GROUP BY 1)"


@register("q9_coverage", f"WITH {V.HOURLY}, {COVER} SELECT *, hours - observed AS missing, round(100.0 * observed / hours, 6) AS pct_observed FROM c")
def _(spark, d):
    return r6(quality.coverage(V.hourly(spark, d), ["series"]), "pct_observed")


GAPS = "n AS (SELECT series, ts, lead(ts) OVER (PARTITION BY series ORDER BY ts) AS u FROM hourly), gaps AS (SELECT series, ts + INTERVAL 1 HOUR AS gap_start, u - INTERVAL 1 HOUR AS gap_end, date_diff('hour', ts, u) - 1 AS hours FROM n WHERE date_diff('hour', ts, u) > 1)"


@register("q10_gap_runs", f"WITH {V.HOURLY}, {GAPS} SELECT * FROM gaps")
def _(spark, d):
    return quality.gap_runs(V.hourly(spark, d), ["series"])


@register("q10_gap_summary", f"WITH {V.HOURLY}, {GAPS} SELECT series, count(*) AS runs, CAST(sum(hours) AS BIGINT) AS missing, max(hours) AS longest, median(hours) AS median FROM gaps GROUP BY 1")
def _(spark, d):
    return quality.gap_summary(quality.gap_runs(V.hourly(spark, d), ["series"]), ["series"])


@register("q10_longest_gaps", f"WITH {V.HOURLY}, {GAPS} SELECT series, gap_start, hours, row_number() OVER (PARTITION BY series ORDER BY hours DESC, gap_start) AS rank FROM gaps QUALIFY rank <= 10")
def _(spark, d):
    g = quality.gap_runs(V.hourly(spark, d), ["series"])
    return quality.top_per_key(g, ["series"], [F.desc("hours"), F.asc("gap_start")], 10).select("series", "gap_start", "hours", "rank")


@register("q12_first_clean_date", f"WITH {V.HOURLY}, {GAPS}, f AS (SELECT max(CAST(a AS DATE)) AS f FROM (SELECT min(ts) AS a FROM hourly GROUP BY series)), o AS (SELECT max(CAST(gap_end AS DATE) + 1) AS o FROM gaps WHERE hours > 1), c AS (SELECT greatest(f, o) AS clean_from FROM f, o) SELECT clean_from, (SELECT count(*) FROM gaps WHERE gap_start >= clean_from) AS later_gaps, (SELECT max(hours) FROM gaps WHERE gap_start >= clean_from) AS longest_later FROM c")
def _(spark, d):
    return quality.first_clean_date(V.hourly(spark, d), ["series"], max_gap=1)


@register("q13_monthly_coverage", f"WITH {V.HOURLY} SELECT series, date_trunc('month', ts)::TIMESTAMP AS month, count(DISTINCT ts) AS observed, count(DISTINCT ts) / (24.0 * day(last_day(date_trunc('month', ts)))) AS share FROM hourly GROUP BY series, date_trunc('month', ts)")
def _(spark, d):
    return quality.monthly_coverage(V.hourly(spark, d), ["series"])


@register("q14_daily_presence", f"WITH {V.HOURLY}, s AS (SELECT series, CAST(ts AS DATE) AS day, count(DISTINCT ts) AS observed FROM hourly WHERE day(ts) % 7 <> 3 GROUP BY ALL), g AS (SELECT series, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s GROUP BY 1) SELECT series, day, coalesce(observed, 0) AS observed, coalesce(observed, 0) = 24 AS complete FROM g LEFT JOIN s USING (series, day)")
def _(spark, d):
    return quality.daily_presence(V.hourly(spark, d).where("day(ts) % 7 <> 3"), ["series"])  # whole days planted as absent


@register("q15_variance_report", f"WITH {V.DAILY}, x AS (SELECT * FROM daily UNION ALL SELECT 'flat', ts, 7.0 FROM daily), g AS (SELECT series, count(value) AS n, avg(value) AS mean, avg(abs(value)) AS mean_abs, var_samp(value) AS var, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, count(DISTINCT value) AS n_unique FROM x GROUP BY 1) SELECT series, n, round(mean, 4) AS mean, round(mean_abs, 4) AS mean_abs, round(var / 1e6, 4) AS var, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, n_unique, round(max - min, 4) AS range, round(std / mean_abs, 6) AS relative_std, max = min AS constant, std <= 0.001 * mean_abs AS practically_zero FROM g")
def _(spark, d):
    x = V.daily(spark, d)
    g = quality.variance_report(x.unionByName(x.select(F.lit("flat").alias("series"), "ts", F.lit(7.0).alias("value"))), ["series"])
    return g.withColumn("var", F.col("var") / 1e6).withColumns({k: F.round(k, 4) for k in ("mean", "mean_abs", "var", "std", "min", "max", "range")}).withColumn("relative_std", F.round("relative_std", 6))


@register("q16_hold_report", "WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER w AS p, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), r AS (SELECT *, sum(CASE WHEN n > 1 AND o_orderstatus = p THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM s), h AS (SELECT o_custkey, run, count(*) AS held, min(o_orderstatus) AS v FROM r GROUP BY ALL) SELECT o_custkey, count(DISTINCT v) AS levels, count(*) AS runs, median(held) AS median_held, max(held) AS max_held FROM h GROUP BY 1")
def _(spark, d):
    return quality.hold_report(V.table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@register("q18_summary_join", f"WITH {V.HOURLY}, {COVER}, {GAPS}, s AS (SELECT series, count(*) AS runs FROM gaps GROUP BY 1) SELECT series, observed, hours, runs FROM c FULL JOIN s USING (series)")
def _(spark, d):
    h = V.hourly(spark, d)
    return quality.summary_join(["series"], quality.coverage(h, ["series"]).select("series", "observed", "hours"), quality.gap_summary(quality.gap_runs(h, ["series"]), ["series"]).select("series", "runs"))


@register("q19_compare_datasets", f"WITH {V.DAILY}, {V.DAILY.replace('daily AS', 'old AS').replace('FROM orders', 'FROM orders WHERE o_orderkey % 50 <> 0')} SELECT 'value' AS \"column\", count(*) FILTER (d.value IS NOT NULL AND o.value IS NOT NULL) AS overlap, count(*) FILTER (o.value IS NULL) AS only_new, count(*) FILTER (d.value IS NULL) AS only_old, count(*) FILTER (abs(d.value - o.value) > 0.01) AS changed, round(max(abs(d.value - o.value)), 4) AS max_diff FROM daily d FULL JOIN old o ON d.series = o.series AND d.ts = o.ts")
def _(spark, d):
    old = V.table(spark, d, "orders").where("o_orderkey % 50 <> 0").groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return quality.compare_datasets(V.daily(spark, d), old, ["series", "ts"], ["value"], 0.01).withColumn("max_diff", F.round("max_diff", 4))


@register("q20_raw_inventory", f"WITH {V.RAW} SELECT zone, variable, psr_type, count(*) AS rows, string_agg(DISTINCT resolution, ',' ORDER BY resolution) AS resolutions, min(ts) AS first, max(ts) AS last FROM raw GROUP BY ALL")
def _(spark, d):
    return quality.raw_inventory(V.raw(spark, d), S)


LAG = "f AS (SELECT series, ts, value, last_value(value IGNORE NULLS) OVER (PARTITION BY series, (epoch(ts)::BIGINT // 3600) % 168 ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM gridded)"


@register("i1_weekly_lag_fill", f"WITH {V.GRIDDED}, {LAG} SELECT series, ts, round(filled, 6) AS filled, value IS NULL AND filled IS NOT NULL AS imputed FROM f")
def _(spark, d):
    return r6(impute.weekly_lag_fill(V.gridded(spark, d), ["series"]).select("series", "ts", "filled", "imputed"), "filled")


I2 = "runs AS (SELECT *, sum(CASE WHEN value IS NULL AND p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS run FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS p FROM two)), r AS (SELECT series, run, min(ts) AS a, max(ts) AS b, count(*) AS n FROM runs WHERE value IS NULL GROUP BY ALL), o AS (SELECT r.*, count(t.value) AS k FROM r JOIN two t ON t.series <> r.series AND t.ts BETWEEN r.a AND r.b GROUP BY ALL), h AS (SELECT o.series, o.run, count(*) AS rows, regr_slope(y.value, x.value) AS sl, regr_intercept(y.value, x.value) AS ic FROM o JOIN two y ON y.series = o.series AND y.ts < o.a JOIN two x ON x.series <> o.series AND x.ts = y.ts WHERE o.k = o.n AND x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY ALL)"


@register("i2_one_predictor", f"WITH {V.GRIDDED}, two AS (SELECT * FROM gridded WHERE series IN ('click', 'view')), {I2} SELECT n.series, n.ts, round(coalesce(n.value, CASE WHEN h.rows >= 168 THEN greatest(0, ic + sl * x.value) END), 5) AS filled FROM runs n LEFT JOIN h ON h.series = n.series AND h.run = n.run AND n.value IS NULL LEFT JOIN two x ON x.series <> n.series AND x.ts = n.ts")
def _(spark, d):
    two = V.gridded(spark, d).where("series IN ('click', 'view')")  # a pair of series is what SQL's regression can say
    return impute.cross_series_ols_fill(two, "series", least=168).select("series", "ts", F.round("filled", 5).alias("filled"))


#: Normal equations of each run over all earlier complete rows, solved by elimination: one column a round.
OLS = """
n AS (SELECT *, sum(CASE WHEN value IS NULL AND (p IS NOT NULL OR i = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS run
  FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS p, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM gridded)),
r AS (SELECT series, run, min(ts) AS a, max(ts) AS b, count(*) AS n FROM n WHERE value IS NULL GROUP BY ALL),
c AS (SELECT r.series, r.run, r.a, g.series AS p FROM r JOIN gridded g ON g.series <> r.series AND g.ts BETWEEN r.a AND r.b AND g.value IS NOT NULL GROUP BY ALL HAVING count(*) = any_value(r.n)),
ps AS (SELECT series, run, a, list(p ORDER BY p) AS ps FROM c GROUP BY ALL),
m AS (SELECT ts, map_from_entries(list((series, value))) AS m FROM gridded WHERE value IS NOT NULL GROUP BY ts),
z AS (SELECT series, run, list_concat([1.0::DOUBLE], list_transform(ps, lambda p: m[p]), [m[series]]) AS z FROM ps JOIN m ON m.ts < ps.a),
v AS (SELECT series, run, z, unnest(range(1, len(z) + 1)) AS i FROM z WHERE len(list_filter(z, lambda x: x IS NULL)) = 0),
w AS (SELECT series, run, i, z, unnest(range(1, len(z) + 1)) AS j FROM v),
s AS (SELECT series, run, i, j, sum(z[i] * z[j]) AS g FROM w GROUP BY ALL),
l AS (SELECT series, run, i, list(g ORDER BY j) AS line FROM s GROUP BY ALL),
e AS (SELECT series, run, 0 AS k, list(line ORDER BY i)[:-2] AS g, min(line[1]) FILTER (i = 1) AS rows FROM l GROUP BY ALL
  UNION ALL SELECT series, run, k + 1, list_transform(g, lambda x, nth: CASE WHEN nth = k + 1 THEN list_transform(x, lambda v: v / x[k + 1]) ELSE list_transform(x, lambda v, col: v - x[k + 1] / g[k + 1][k + 1] * g[k + 1][col]) END), rows FROM e WHERE k < len(g)),
beta AS (SELECT series, run, rows, list_transform(g, lambda x: x[-1]) AS beta FROM e WHERE k = len(g)),
f AS (SELECT n.series, n.ts, n.value, ps.ps, CASE WHEN n.value IS NULL AND rows >= 168 THEN greatest(0, list_dot_product(beta, list_concat([1.0::DOUBLE], list_transform(ps.ps, lambda p: m.m[p])))) END AS f
  FROM n LEFT JOIN ps ON ps.series = n.series AND ps.run = n.run AND n.value IS NULL LEFT JOIN beta ON beta.series = n.series AND beta.run = n.run LEFT JOIN m ON m.ts = n.ts)
SELECT series, ts, round(coalesce(value, f), 5) AS filled, f IS NOT NULL AS imputed, CASE WHEN f IS NOT NULL THEN 'ols' END AS method, CASE WHEN f IS NOT NULL THEN array_to_string(ps, ',') END AS predictors FROM f
"""


@register("i2_cross_series_ols_fill", f"WITH RECURSIVE {V.GRIDDED}, {OLS}")
def _(spark, d):
    f = impute.cross_series_ols_fill(V.gridded(spark, d), "series", least=168)
    return f.select("series", "ts", F.round("filled", 5).alias("filled"), "imputed", F.col("imputation_method").alias("method"), F.array_join("imputation_predictors", ",").alias("predictors"))


@register("i4_row_for_fill", f"WITH {V.GRIDDED}, m AS (SELECT g.series, g.ts, g.value, h.note FROM gridded g LEFT JOIN (SELECT event_type AS series, date_trunc('hour', ts) AS ts, max(event_id) AS note FROM events GROUP BY ALL) h ON h.series = g.series AND h.ts = g.ts) SELECT series, ts, coalesce(note, lag(note, 168) OVER w, last_value(note IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS note FROM m WINDOW w AS (PARTITION BY series ORDER BY ts)")
def _(spark, d):
    e = V.table(spark, d, "events").groupBy(F.col("event_type").alias("series"), grid.hour_of(F.col("ts")).alias("ts")).agg(F.max("event_id").alias("note"))
    g = V.gridded(spark, d).join(e, ["series", "ts"], "left")
    return impute.row_for_fill(g, ["series"], ["note"]).select("series", "ts", "note")


@register("i3_route_fill", f"WITH {V.GRIDDED}, {LAG}, d AS (SELECT series, ts, value, coalesce(value, lag(value, 24) OVER (PARTITION BY series ORDER BY ts)) AS filled FROM gridded) SELECT series, ts, round(filled, 6) AS filled FROM f WHERE series IN ('click', 'view') UNION ALL SELECT series, ts, round(filled, 6) FROM d WHERE series NOT IN ('click', 'view')")
def _(spark, d):
    lag = lambda x: impute.weekly_lag_fill(x, ["series"])
    shift = lambda x: impute.fill_by_shift(x, ["series"], 24, 1).withColumn("filled", F.col("value"))
    rules = {z: lag if z in ("click", "view") else shift for z in ZONES}
    return r6(impute.route_fill(V.gridded(spark, d), "series", rules).select("series", "ts", "filled"), "filled")


FFILL = "a AS (SELECT *, count(value) OVER (PARTITION BY series ORDER BY ts) AS run, max(CASE WHEN value IS NOT NULL THEN ts END) OVER (PARTITION BY series) AS o FROM gridded), b AS (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series, run) AS n, max(value) OVER (PARTITION BY series, run) AS v FROM a), ff AS (SELECT series, ts, value AS orig, coalesce(value, CASE WHEN run > 0 AND n <= {} AND ts < o THEN v END) AS value FROM b)"


@register("i5_ffill_short", f"WITH {V.GRIDDED}, {FFILL.format(1)} SELECT series, ts, round(value, 6) AS filled FROM ff")
def _(spark, d):
    return r6(impute.ffill_short(V.gridded(spark, d), ["series"], most=1).select("series", "ts", "filled"), "filled")


def _shifts(step: int, passes: int, start: str) -> str:
    out, last = [], start
    for k in range(1, passes + 1):
        out.append(f"s{step}_{k} AS (SELECT * REPLACE (coalesce(value, lag(value, {step * k}) OVER (PARTITION BY series ORDER BY ts)) AS value) FROM {last})")
        last = f"s{step}_{k}"
    return ", ".join(out)


@register("i6_fill_by_shift", f"WITH {V.GRIDDED}, {_shifts(168, 8, 'gridded')}, {_shifts(24, 6, 's168_8')} SELECT series, ts, round(value, 6) AS value FROM s24_6")
def _(spark, d):
    g = impute.fill_by_shift(V.gridded(spark, d), ["series"], 168, 8)
    return r6(impute.fill_by_shift(g, ["series"], 24, 6), "value")


@register("i7_expanding_hour_median", f"WITH {V.GRIDDED}, m AS (SELECT g.series, g.ts, median(h.value) AS m FROM gridded g JOIN gridded h ON g.series = h.series AND hour(g.ts) = hour(h.ts) AND h.ts < g.ts WHERE g.value IS NULL AND h.value IS NOT NULL GROUP BY ALL) SELECT g.series, g.ts, round(coalesce(g.value, m.m), 6) AS filled FROM gridded g LEFT JOIN m ON g.series = m.series AND g.ts = m.ts")
def _(spark, d):
    return r6(impute.expanding_hour_median(V.gridded(spark, d), ["series"]).select("series", "ts", "filled"), "filled")


CASCADE = f"{FFILL.format(3)}, {_shifts(168, 8, 'ff')}, {_shifts(24, 6, 's168_8')}, md AS (SELECT g.series, g.ts, median(h.value) AS m FROM s24_6 g JOIN s24_6 h ON g.series = h.series AND hour(g.ts) = hour(h.ts) AND h.ts < g.ts WHERE g.value IS NULL AND h.value IS NOT NULL GROUP BY ALL), cas AS (SELECT a.series, a.ts, coalesce(c.value, m) AS value, CASE WHEN a.orig IS NOT NULL THEN 'observed' WHEN a.value IS NOT NULL THEN 'ffill' WHEN b.value IS NOT NULL THEN 'weekly_shift' WHEN c.value IS NOT NULL THEN 'daily_shift' WHEN m IS NOT NULL THEN 'hour_median' ELSE 'unfilled' END AS method FROM ff a JOIN s168_8 b USING (series, ts) JOIN s24_6 c USING (series, ts) LEFT JOIN md USING (series, ts))"


@register("i8_impute_cascade", f"WITH {V.GRIDDED}, {CASCADE} SELECT series, ts, round(value, 6) AS value, method FROM cas")
def _(spark, d):
    return r6(impute.impute_cascade(V.gridded(spark, d), ["series"]).select("series", "ts", "value", "method"), "value")


METHODS = ["ffill", "weekly_shift", "daily_shift", "hour_median"]


@register("q17_imputation_report", f"WITH {V.GRIDDED}, {CASCADE} SELECT series, count(*) AS hours, CAST(count(*) FILTER (method <> 'observed') AS BIGINT) AS missing, round(count(*) FILTER (method <> 'observed') / count(*), 9) AS share, " + ", ".join(f"CAST(count(*) FILTER (method = '{m}') AS BIGINT) AS {m}" for m in [*METHODS, "unfilled"]) + " FROM cas GROUP BY 1")
def _(spark, d):
    return quality.imputation_report(impute.impute_cascade(V.gridded(spark, d), ["series"]), ["series"], METHODS).withColumn("share", F.round("share", 9))


@register("i9_trim_to_first_complete_day", f"WITH {V.GRIDDED}, {_shifts(24, 3, 'gridded')}, z AS (SELECT *, 'all' AS zone FROM s24_3), k AS (SELECT zone, CAST(ts AS DATE) AS day, series, count(value) = 24 AS ok FROM z GROUP BY ALL), f AS (SELECT zone, min(day) AS first FROM (SELECT zone, day FROM k GROUP BY ALL HAVING count(*) FILTER (ok) = (SELECT count(DISTINCT series) FROM z)) GROUP BY 1) SELECT series, ts FROM z JOIN f USING (zone) WHERE CAST(ts AS DATE) >= first")
def _(spark, d):
    g = impute.fill_by_shift(V.gridded(spark, d), ["series"], 24, 3).withColumn("zone", F.lit("all"))
    return impute.trim_to_first_complete_day(g, ["zone"], "series").select("series", "ts")
