"""Validation: each check returns its violations; no row means it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import carry, grid

#: Seconds of the steps that grids have.
STEPS = {"MINUTE": 60, "HOUR": 3600, "DAY": 86400}


def grid_violations(df: DataFrame, keys: list[str], ts: str = "ts", value: str | None = None, step: str = "HOUR") -> DataFrame:
    """Stamps that repeat, that follow by part of a step (``off grid``) or by several (``gap``), or that hold a null.

    Rows have no order in a table, so sortedness is that of the stamps.
    """
    prev = carry.scan(df, keys, ts, before={"_prev": F.col(ts)})
    d = F.timestamp_diff("SECOND", F.col("_prev"), F.col(ts))
    what = F.when(d == 0, "repeated").when(d % STEPS[step] != 0, "off grid").when(d > STEPS[step], "gap")
    if value:
        what = F.coalesce(what, F.when(F.col(value).isNull(), "null"))
    return prev.select(*keys, F.col(ts).alias("ts"), what.alias("violation")).where("violation IS NOT NULL")


def whole_day_violations(df: DataFrame, keys: list[str], ts: str = "ts", slots: int = 24) -> DataFrame:
    """Keys whose grid does not run from 00:00 of a day to the last slot of one: first and last stamp and rows beyond whole days."""
    step = 1440 // slots
    g = df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("_n"))
    at = lambda c: F.hour(c) * 60 + F.minute(c)
    g = g.withColumn("beyond", F.col("_n") % slots).drop("_n")
    return g.where((at("first") != 0) | (at("last") != 1440 - step) | (F.col("beyond") != 0))


def load_guards(df: DataFrame, zones: list[str], excluded: list[str], start: str, end: str, product: tuple[str, str, str] | None = None, price: str = "price", tol: float = 0.0) -> DataFrame:
    """Violations (guard, detail) of a raw panel (zone, variable, psr_type, resolution, ts, value) that has been read with predicates.

    Guards: ``zone absent``; ``variable excluded``; ``before start`` and ``after end``
    (of the whole last hour); ``product`` (zone, variable, resolution): another resolution
    of that series; ``quarters differ``: price hours without an hourly value whose
    quarters are not equal.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 hour")
    spark = df.sparkSession
    absent = spark.createDataFrame([(z,) for z in zones], "detail string").join(df.select(F.col("zone").alias("detail")).distinct(), "detail", "left_anti")
    name = lambda x, guard: x.select(F.lit(guard).alias("guard"), F.col("detail").cast("string").alias("detail"))
    out = name(absent, "zone absent").unionByName(name(df.where(F.col("variable").isin(*excluded)).select(F.col("variable").alias("detail")).distinct(), "variable excluded"))
    early = df.agg(F.min("ts").alias("detail")).where(F.col("detail") < lo)
    late = df.agg(F.max("ts").alias("detail")).where(F.col("detail") >= hi)
    out = out.unionByName(name(early, "before start")).unionByName(name(late, "after end"))
    if product:
        z, v, r = product
        out = out.unionByName(name(df.where((F.col("zone") == z) & (F.col("variable") == v) & (F.col("resolution") != r)).select(F.col("resolution").alias("detail")).distinct(), "product"))
    h = df.where(F.col("variable") == price).groupBy("zone", "psr_type", grid.hour_of(F.col("ts")).alias("hour"))
    h = h.agg(F.bool_or(F.col("resolution") == "PT60M").alias("hourly"), (F.max("value") - F.min("value")).alias("spread"))
    bad = h.where(~F.col("hourly") & (F.col("spread") > tol)).groupBy("zone").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "zone", "n").alias("detail"))
    return out.unionByName(name(bad, "quarters differ"))


def run_checks(wide: DataFrame, features: DataFrame, columns: list[str], n_features: int, test_days: int, burn_in: int, ts: str = "ts", zone: str = "zone") -> DataFrame:
    """(zone, name, passed, detail) of what a walk-forward run needs, by zone.

    ``layout``: the wide table has these columns without nulls; ``features``: each row has
    so many; ``test days``: as many days follow the burn-in; ``burn-in``: days before the
    first feature row; ``days``: the zone has the days that all zones together have.
    """
    n = wide.groupBy(zone).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"_{c}") for c in columns if c in wide.columns], F.min(F.to_date(ts)).alias("first"), F.count_distinct(F.to_date(ts)).alias("days"))
    lacking = [c for c in columns if c not in wide.columns]
    full = F.lit(not lacking)
    for c in columns:
        if c not in lacking:
            full = full & (F.col(f"_{c}") == F.col("rows"))
    f = features.groupBy(zone).agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.min("day").alias("f1"), F.count("*").alias("fd"))
    every = wide.select(F.to_date(ts).alias("d")).distinct().agg(F.count("*").alias("every"))
    j = n.join(f, zone, "left").crossJoin(every)
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    made = [
        ("layout", full, text(F.lit(len(columns) - len(lacking)))),
        ("features", (F.col("lo") == n_features) & (F.col("hi") == n_features), text(F.col("lo"), F.col("hi"))),
        ("test days", F.col("fd") >= test_days, text(F.col("fd"))),
        ("burn-in", F.datediff("f1", "first") >= burn_in, text(F.datediff("f1", "first"))),
        ("days", F.col("days") == F.col("every"), text(F.col("days"), F.col("every"))),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(c, F.lit(False)).alias("passed"), d.alias("detail")) for k, c, d in made])
    return j.select(zone, F.explode(rows).alias("r")).select(zone, "r.*")


def day_violations(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", slots: int = 24) -> DataFrame:
    """Days from a key's first to its last without exactly ``slots`` distinct stamps and values, days without any row included."""
    g = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("rows"), F.count_distinct(ts).alias("stamps"), F.count(value).alias("values"))
    g = grid.on_grid(g, keys, "day", "1 day").na.fill(0, ["rows", "stamps", "values"])
    return g.where((F.col("rows") != slots) | (F.col("stamps") != slots) | (F.col("values") != slots))


def spring_violations(df: DataFrame, keys: list[str], tz: str, local: str = "local", value: str = "value", tol: float = 1e-9) -> DataFrame:
    """Skipped hours that are not the mean of their neighbours."""
    near = F.struct(F.col(value).alias("v"))
    d = carry.scan(df, keys, local, before={"_l": near}, after={"_r": near}).withColumn("_m", (F.col("_l.v") + F.col("_r.v")) / 2)
    return d.where(grid.is_skipped(F.col(local), tz) & (F.abs(F.col(value) - F.col("_m")) > tol)).select(*keys, local, value)


def early_levels(held: DataFrame, levels: DataFrame, keys: list[str], ts: str, level_ts: str, level: str, delay: str) -> DataFrame:
    """Grid stamps that show another level than the last one published by then (``delay`` after its stamp): any level before the first, a later one too early."""
    due = grid.step_hold(held.select(*keys, ts), levels, keys, ts, level_ts, level, delay).withColumnRenamed("level", "_due")
    return held.join(due, [*keys, ts]).where(F.col("level").isNotNull() & ~F.col("level").eqNullSafe(F.col("_due"))).select(*keys, ts)


def smeared_hours(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tol: float = 1e-9) -> DataFrame:
    """Hours whose slots differ."""
    g = df.groupBy(*keys, grid.hour_of(F.col(ts)).alias("hour")).agg((F.max(value) - F.min(value)).alias("spread"))
    return g.where(F.col("spread") > tol)


def misaligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of only one of two inputs."""
    j = a.select(*keys, F.lit(True).alias("_a")).join(b.select(*keys, F.lit(True).alias("_b")), keys, "full_outer")
    return j.where("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in"))


def preflight(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row (name, passed, detail) for each named (condition, detail) over the whole table, in one pass."""
    row = df.agg(*[x for i, (c, t) in enumerate(checks.values()) for x in (c.alias(f"c{i}"), t.cast("string").alias(f"d{i}"))])
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("passed"), F.col(f"d{i}").alias("detail")) for i, n in enumerate(checks)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
