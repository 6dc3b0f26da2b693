"""Scalers fitted by group as tables of parameters; constant columns scale to 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 0.75 quantile of the standard normal.
NORMAL = 0.6744897501960817
KINDS = ("Norm", "Norm1", "Std", "Median", "Invariant")


def scaler_fit(df: DataFrame, keys: list[str], kind: str, value: str = "value") -> DataFrame:
    """(keys, centre, spread, constant); a spread of 0 becomes 1."""
    if kind in ("Norm", "Norm1"):
        g = df.groupBy(*keys).agg(F.min(value).alias("centre"), (F.max(value) - F.min(value)).alias("spread"))
    elif kind == "Std":
        g = df.groupBy(*keys).agg(F.avg(value).alias("centre"), F.stddev_pop(value).alias("spread"))
    elif kind in ("Median", "Invariant"):
        med = df.groupBy(*keys).agg(F.median(value).alias("centre"))
        g = df.join(med, keys).groupBy(*keys).agg(F.first("centre").alias("centre"), (F.median(F.abs(F.col(value) - F.col("centre"))) / NORMAL).alias("spread"))
    else:
        raise ValueError(f"scaler {kind} is none of {KINDS}")
    return g.withColumn("constant", F.col("spread") == 0).withColumn("spread", F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread")))


def _forward(kind: str, x: Column, c: Column, s: Column) -> Column:
    z = (x - c) / s
    return {"Norm1": 2 * z - 1, "Invariant": F.asinh(z)}.get(kind, z)


def _back(kind: str, z: Column, c: Column, s: Column) -> Column:
    z = {"Norm1": (z + 1) / 2, "Invariant": F.sinh(z)}.get(kind, z)
    return z * s + c


def scaler_transform(df: DataFrame, params: DataFrame, keys: list[str], kind: str, value: str = "value", out: str = "scaled") -> DataFrame:
    return df.join(params.select(*keys, "centre", "spread"), keys).withColumn(out, _forward(kind, F.col(value), F.col("centre"), F.col("spread"))).drop("centre", "spread")


def scaler_inverse(df: DataFrame, params: DataFrame, keys: list[str], kind: str, value: str = "scaled", out: str = "value") -> DataFrame:
    return df.join(params.select(*keys, "centre", "spread"), keys).withColumn(out, _back(kind, F.col(value), F.col("centre"), F.col("spread"))).drop("centre", "spread")


def scaling(datasets: list[DataFrame], keys: list[str], kind: str, value: str = "value") -> tuple[DataFrame, list[DataFrame]]:
    """The first dataset's parameters, and all datasets scaled by them. Keys the first one lacks are left out."""
    p = scaler_fit(datasets[0], keys, kind, value)
    return p, [scaler_transform(d, p, keys, kind, value) for d in datasets]


def zone_scaler_report(df: DataFrame, zone: str, slot: str, kind: str, value: str = "value") -> DataFrame:
    """Of each zone's scalers by slot: constant columns, deviation of all scaled values, largest error of scaling back, and the deviation over the smallest of any zone."""
    p = scaler_fit(df, [zone, slot], kind, value)
    t = scaler_inverse(scaler_transform(df, p, [zone, slot], kind, value), p, [zone, slot], kind, "scaled", "_back")
    g = t.groupBy(zone).agg(F.stddev_pop("scaled").alias("dispersion"), F.max(F.abs(F.col(value) - F.col("_back"))).alias("max_error"))
    g = g.join(p.groupBy(zone).agg(F.sum(F.col("constant").cast("int")).alias("constant_columns")), zone)
    least = g.agg(F.min(F.when(F.col("dispersion") > 0, F.col("dispersion"))).alias("_least"))
    return g.crossJoin(least).withColumn("times_least", F.col("dispersion") / F.col("_least")).drop("_least")


def equals_pooled(df: DataFrame, zone: str, kind: str, by_zone: list[str], pooled: list[str], value: str = "value", tol: float = 1e-9) -> DataFrame:
    """(zone, equal, largest difference): whether scalers fitted zone by zone (keys ``by_zone``) and one pooled fit (keys ``pooled``) scale a zone's values alike."""
    fits = [scaler_fit(df, keys, kind, value).select(*keys, F.col("centre").alias(f"_c{i}"), F.col("spread").alias(f"_s{i}")) for i, keys in enumerate((by_zone, pooled))]
    both = df.join(fits[0], by_zone).join(fits[1], pooled)
    gap = F.abs(_forward(kind, F.col(value), F.col("_c0"), F.col("_s0")) - _forward(kind, F.col(value), F.col("_c1"), F.col("_s1")))
    g = both.groupBy(zone).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("difference"))
    return g.select(zone, (F.col("difference") <= tol).alias("equal"), "difference")


def round_trip_check(df: DataFrame, keys: list[str], kind: str, value: str = "value") -> DataFrame:
    """Largest error of scaling and back, and the deviation of the scaled values, by group."""
    p = scaler_fit(df, keys, kind, value)
    t = scaler_inverse(scaler_transform(df, p, keys, kind, value), p, keys, kind, "scaled", "_back")
    return t.groupBy(*keys).agg(F.max(F.abs(F.col(value) - F.col("_back"))).alias("max_error"), F.stddev_pop("scaled").alias("dispersion"))
