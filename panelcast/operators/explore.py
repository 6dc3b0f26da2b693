"""Exploratory aggregations of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import gram, intervals


def pivot_panel(df: DataFrame, ts: str, series: str, values: list[str], value: str = "value") -> DataFrame:
    """Stamps by series; with the list given, one shuffle and no pass to find the columns."""
    return df.groupBy(ts).pivot(series, values).agg(F.first(value))


def dispersion(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    seen = F.when(F.col(value).isNotNull(), F.col(ts))
    return df.groupBy(*keys).agg(F.count(value).alias("obs"), F.min(seen).alias("first"), F.max(seen).alias("last"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def pairwise(df: DataFrame, series: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Covariance, correlation and number of common stamps of each pair of series (a <= b), by tiles of sums of products."""
    return gram.pairwise(df, series, ts, value)


def top_bottom_pairs(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The n pairs of highest and of lowest correlation."""
    p = pairs.where("a < b").select("a", "b", "corr")
    hi = p.orderBy(F.desc("corr"), "a", "b").limit(n).withColumn("side", F.lit("top"))
    return hi.unionByName(p.orderBy("corr", "a", "b").limit(n).withColumn("side", F.lit("bottom")))


def period_summary(df: DataFrame, periods: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean, median, deviation and number of negatives for each of some overlapping periods (period, start, end)."""
    j = intervals.points_in(df, periods, [], ts, "start", "end")
    return j.groupBy(*keys, "period").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.sum((F.col(value) < 0).cast("int")).alias("negatives"))


def average_week(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean of each hour of the week, 0 on Monday midnight; ``complete_week`` tells keys that lack some of the 168."""
    return df.groupBy(*keys, (F.weekday(ts) * 24 + F.hour(ts)).alias("hour_of_week")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def complete_week(week: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose average week lacks an hour, and how many."""
    return week.groupBy(*keys).agg((168 - F.count("mean")).alias("lacking")).where("lacking > 0")


def shared_histogram(df: DataFrame, period: Column, bins: int = 60, value: str = "value") -> DataFrame:
    """Densities by period over common bins of the union."""
    d = df.where(F.col(value).isNotNull()).withColumn("period", period)
    edge = d.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / w), F.lit(bins - 1)).cast("int")
    g = d.crossJoin(F.broadcast(edge)).withColumn("_w", w).groupBy("period", b.alias("bin")).agg(F.count("*").alias("n"), F.first("_w").alias("_w"))
    total = d.groupBy("period").agg(F.count("*").alias("_t"))
    return g.join(total, "period").select("period", "bin", "n", (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density"))


def stabilisation_report(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", rows: int = 168) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, and the range of the rolling deviation over the whole one."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(rows - 1), 0)
    d = df.withColumn("_s", F.when(F.count(value).over(w) == rows, F.stddev_samp(value).over(w)))
    g = d.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"), F.stddev_samp(value).alias("_sd"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    n = F.col("n")
    skew = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    return g.select(*keys, "n", skew.alias("skew"), kurt.alias("kurtosis"), ((F.col("_hi") - F.col("_lo")) / F.col("_sd")).alias("rolling_range"))


def stabilisation_comparison(df: DataFrame, keys: list[str], raw: str, transformed: str, ts: str = "ts", rows: int = 168) -> DataFrame:
    """``stabilisation_report`` of a raw and a transformed column side by side (suffix ``_t``)."""
    a, b = (stabilisation_report(df, keys, ts, c, rows) for c in (raw, transformed))
    return a.join(b.select(*keys, *[F.col(c).alias(f"{c}_t") for c in ("skew", "kurtosis", "rolling_range")]), keys)


def capacity_long(rows: DataFrame, dim: DataFrame, names: dict[str, str], expected: DataFrame, zone: str = "zone", psr: str = "psr_type") -> tuple[DataFrame, DataFrame]:
    """Installed capacities with area and type names, and the expected (zone, year) that nothing was published for.

    ``rows`` has zone, year, psr_type, value and unit; rows without a value are left out.
    Unknown types keep their code.
    """
    r = rows.where("value IS NOT NULL").join(dim.select(zone, F.col("name").alias("area_name"), "eic"), zone)
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(psr))
    long = r.select(zone, "area_name", "eic", "year", psr, F.coalesce(code, F.col(psr)).alias("production_type"), "value", "unit")
    return long, expected.select(zone, "year").join(rows.select(zone, "year").distinct(), [zone, "year"], "left_anti")


def capacity_wide(df: DataFrame, keys: list[str], kind: str, kinds: list[str], value: str) -> DataFrame:
    """One column for each kind in the order given, absent kinds 0, and their total."""
    p = df.groupBy(*keys).pivot(kind, kinds).sum(value).na.fill(0, kinds)
    total = F.lit(0.0)
    for k in kinds:
        total = total + F.col(f"`{k}`")
    return p.withColumn("Total", total)
