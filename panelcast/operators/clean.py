"""Whole cleaning runs, composed of the single operators; one lazy plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import filters, grid, impute, quality
from panelcast.sources.scratch import stage


def clean_v1(raw: DataFrame, series: list[str], zone: str = "zone", max_pct_zero: float = 90.0, unwanted: DataFrame | None = None, stepped: DataFrame | None = None, delay: str = "7 days") -> DataFrame:
    """Dedupe, drop unwanted and near-constant series, cut at the stamp all zones reach, collapse to hours.

    ``stepped``: weekly levels (``series``, level_ts, level); each comes on the grid of its
    zone's hours from ``delay`` after its stamp on, as rows like all others with 0 slots.
    """
    d = quality.dedupe(raw, [*series, "resolution", "ts"], "ingest_seq", "value")
    if unwanted is not None:
        d = filters.drop_series(d, unwanted)
    d = filters.drop_near_constant(d, series, max_pct_zero=max_pct_zero)
    cut = grid.global_cutoff(d, zone, [c for c in series if c != zone]).select("cutoff").distinct()
    d = d.crossJoin(F.broadcast(cut)).where(F.col("ts") <= F.col("cutoff")).drop("cutoff")  # one row
    out = grid.collapse_to_hour(d, series).select(*series, "hour", "value", "slots")
    if stepped is None:
        return out
    hours = out.groupBy(zone).agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    g = stepped.select(*series).distinct().join(hours, zone).select(*series, F.explode(F.expr("sequence(_a, _b, interval 1 hour)")).alias("hour"))
    held = grid.step_hold(g, stepped, series, "hour", "level_ts", "level", delay).where("level IS NOT NULL")
    return out.unionByName(held.select(*series, "hour", F.col("level").alias("value"), F.lit(0).cast("long").alias("slots")))


def clean_v2(raw: DataFrame, series: list[str], resolutions: list[str], start: str, latest_start: str, unwanted: DataFrame | None, tz: str, lagged: list[str], regressed: list[str], variable: str = "variable", max_pct_zero: float = 90.0, least: int = 672, shift: str | None = None) -> DataFrame:
    """A raw panel to clean local days; the gridded panel is written once, as the rules read it several times.

    Dedupe; hourly means by resolution; the preferred resolution; from ``start`` on without
    series that begin after ``latest_start``, are near constant or unwanted; one grid for
    all; gaps of ``lagged`` variables from the week before, those of ``regressed`` ones by
    regression on the other series of the variable; local days. (``series``, local, value,
    imputed, imputation_method, dst_adjustment, violation); a variable with neither rule is
    an error. ``shift`` moves all stamps before they become local.
    """
    d = quality.dedupe(raw, [*series, "resolution", "ts"], "ingest_seq", "value")
    h = grid.resolution_precedence(grid.collapse_to_hour(d, [*series, "resolution"]), [*series, "hour"], resolutions)
    h = h.select(*series, F.col("hour").alias("ts"), "value")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    h = filters.drop_near_constant(filters.drop_late_series(h, series, stamp(latest_start)), series, max_pct_zero=max_pct_zero)
    h = filters.trim_start(h if unwanted is None else filters.drop_series(h, unwanted), stamp(start))
    span = h.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))  # one row
    g = h.select(*series).distinct().crossJoin(span).select(*series, F.explode(F.expr("sequence(_a, _b, interval 1 hour)")).alias("ts"))
    g = stage(g.join(h, [*series, "ts"], "left").withColumn("_s", F.concat_ws("\u0001", *series)), "gridded")
    cols = [*series, "ts", "filled", "imputed", "imputation_method"]
    rules = {v: lambda x: impute.weekly_lag_fill(x, series).select(cols) for v in lagged}
    rules |= {v: lambda x: impute.cross_series_ols_fill(x, "_s", least=least, kind=variable).select(cols) for v in regressed}
    f = impute.route_fill(g, variable, rules).withColumnRenamed("filled", "value")
    f = f.withColumns({"imputed": F.coalesce("imputed", F.lit(False)), "imputation_method": F.coalesce("imputation_method", F.lit("none"))})
    if shift:
        f = f.withColumn("ts", F.col("ts") + F.expr(f"interval {shift}"))
    return grid.local_day_normalize(f, series, tz, ["imputed"], {"imputation_method": "none"})


def build_model_panel(raw: DataFrame, series: list[str], tz: str | Column, together: list[str] | None = None) -> DataFrame:
    """Hourly means on the local grid, the skipped hour filled, other gaps by the cascade, from the first day complete in all series.

    ``tz``: a time zone, or a column of ``series``. ``together``: columns of ``series`` (a
    zone) whose series share a first complete day; all series do without.
    """
    g = grid.fill_skipped_hours(grid.to_local_grid(raw, series, tz), series, tz)
    d = impute.impute_cascade(g, series, "local").withColumn("_all", F.lit(1))
    return impute.trim_to_first_complete_day(d.withColumn("_s", F.concat_ws("|", *series)), together or ["_all"], "_s", "local").drop("_all", "_s", "n_utc")
