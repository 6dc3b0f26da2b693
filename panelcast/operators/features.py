"""Lag-feature tables from day arrays: one row for each key and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_arrays(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", slots: int = 24) -> DataFrame:
    """An array of each column's ``slots`` values for each key and whole day; days with a missing slot or value are left out."""
    aggs = [F.transform(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in columns]
    full = [F.count(c).alias(f"_n_{c}") for c in columns]
    g = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(*aggs, *full)
    for c in columns:
        g = g.where(F.col(f"_n_{c}") == slots)
    return g.drop(*[f"_n_{c}" for c in columns])


def lagged(days: DataFrame, keys: list[str], columns: dict[str, list[int]]) -> DataFrame:
    """Columns ``c_k`` with the array of c, k calendar days before; rows with one missing are dropped.

    The lag is a row lag that must hit the calendar day, so one sort by key serves all.
    """
    n = F.datediff("day", F.lit("1970-01-01"))
    d = days.withColumn("_d", n)
    made = []
    for c, lags in columns.items():
        for k in lags:
            name = f"{c}_{k}"
            at = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-k, -k)
            d = d.withColumn(name, F.first(c).over(at) if k else F.col(c))
            made.append(name)
    return d.dropna(subset=made).drop("_d")


def weekday_dummies(day: Column) -> Column:
    """Seven indicators, Monday first."""
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.weekday(day) == i).cast("double"))


def _hour_major(names: list[str]) -> Column:
    """Hour after hour, the values of all these day arrays."""

    def pick(row: Column) -> Column:
        return F.array(*[row[n] for n in names])

    return F.flatten(F.transform(F.arrays_zip(*[F.col(n) for n in names]), pick))


def lag_features(days: DataFrame, keys: list[str], price: str, exog: list[str], price_lags: tuple[int, ...] = (1, 2, 3, 7), exog_lags: tuple[int, ...] = (1, 7, 0), dummies: bool = True) -> DataFrame:
    """(keys, day, features, target): hour by hour the prices of the lag days; then hour by hour, lag day after lag day, all exogenous columns; then the weekday."""
    d = lagged(days, keys, {price: list(price_lags), **{x: list(exog_lags) for x in exog}})
    parts = [_hour_major([f"{price}_{k}" for k in price_lags])]
    if exog:
        parts.append(_hour_major([f"{x}_{k}" for k in exog_lags for x in exog]))
    if dummies:
        parts.append(weekday_dummies(F.col("day")))
    return d.select(*keys, "day", F.concat(*parts).alias("features"), F.col(price).alias("target"))


def feature_names(price_lags: tuple[int, ...], exog: list[str], exog_lags: tuple[int, ...], slots: int = 24, dummies: bool = True) -> list[str]:
    """Names in the order of ``lag_features``."""
    out = [f"price_{_day(k)}_h{h}" for h in range(slots) for k in price_lags]
    out += [f"{x}_{_day(k)}_h{h}" for h in range(slots) for k in exog_lags for x in exog]
    return out + [f"weekday_{i}" for i in range(7)] * dummies


def _day(lag: int) -> str:
    return f"D-{lag}" if lag else "D"


def continuous_weekday(ts: Column) -> Column:
    """Monday midnight is 0, an hour 1/24."""
    return F.weekday(ts) + F.hour(ts) / 24


def toggled_features(days: DataFrame, keys: list[str], price: str, price_lags: tuple[int, ...], exog: dict[str, tuple[int, ...]], calendar: bool = True, past: tuple[int, ...] = (1, 7)) -> DataFrame:
    """(keys, day, features, target) of the blocks switched on: the continuous weekday, then prices hour by hour, then exogenous columns hour by hour.

    ``price_lags`` and ``exog`` (column to lags, 0 for day D) name the blocks; within an
    hour past lags come before day D, and columns in their order within a lag.
    """
    d = lagged(days, keys, {price: sorted({0, *price_lags}), **{x: list(ks) for x, ks in exog.items() if ks}})
    parts = [F.array(continuous_weekday(F.col("day").cast("timestamp_ntz")))] if calendar else []
    if price_lags:
        parts.append(_hour_major([f"{price}_{k}" for k in price_lags]))
    names = [f"{x}_{k}" for k in (*past, 0) for x, ks in exog.items() if k in ks]
    if names:
        parts.append(_hour_major(names))
    return d.select(*keys, "day", F.concat(*parts).alias("features"), F.col(f"{price}_0").alias("target"))


Blocks = dict[str, dict[str, tuple[int, ...]]]


def zone_blocks(days: DataFrame, zone: str, blocks: Blocks, calendar: bool = True, target: str | None = None) -> DataFrame:
    """(day, features, target): the weekday, then zone after zone, in each column after column, in each lag after lag.

    ``blocks``: of each zone its columns and their lags; zones may have different ones.
    Days that a zone or a lag lacks are dropped. The target holds the zones' day arrays
    of ``target`` (each zone's first column) one after the other.
    """
    parts, top = None, {z: target or next(iter(cols)) for z, cols in blocks.items()}
    for z, cols in blocks.items():
        d = lagged(days.where(F.col(zone) == z), [zone], {c: sorted({0, *ks}) if c == top[z] else list(ks) for c, ks in cols.items()})
        x = F.concat(*[F.col(f"{c}_{k}") for c, ks in cols.items() for k in ks])
        d = d.select(F.lit(z).alias("_z"), "day", x.alias("x"), F.col(f"{top[z]}_0").alias("y"))
        parts = d if parts is None else parts.unionByName(d)
    zs = list(blocks)
    p = parts.groupBy("day").pivot("_z", zs).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    p = p.dropna(subset=[f"{z}_{c}" for z in zs for c in "xy"])
    x = F.concat(*([F.array(F.weekday("day").cast("double"))] if calendar else []), *[F.col(f"`{z}_x`") for z in zs])
    return p.select("day", x.alias("features"), F.concat(*[F.col(f"`{z}_y`") for z in zs]).alias("target"))


def zone_block_names(blocks: Blocks, calendar: bool = True, slots: int = 24) -> list[str]:
    """Names in the order of ``zone_blocks``; their number is the width."""
    return ["weekday"] * calendar + [f"{z}_{c}_{_day(k)}_h{h}" for z, cols in blocks.items() for c, ks in cols.items() for k in ks for h in range(slots)]


def zone_block_labels(blocks: Blocks, calendar: bool = True, slots: int = 24) -> list[tuple[str, str]]:
    """(zone, zone/column) of each feature, ``calendar`` for the weekday."""
    return [("calendar", "calendar")] * calendar + [(z, f"{z}/{c}") for z, cols in blocks.items() for c, ks in cols.items() for _ in range(slots * len(ks))]


def null_cells(df: DataFrame, names: list[str], array: str = "features") -> DataFrame:
    """(day, name) of each null in the feature arrays: matrices with any are refused."""
    cells = df.select("day", F.posexplode(array).alias("_p", "_v")).where("_v IS NULL OR isnan(_v)")
    return cells.select("day", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_p") + 1).alias("name"))


def zone_matrices(panel: DataFrame, zone: str, columns: list[str], ts: str = "ts", slots: int = 24) -> tuple[DataFrame, DataFrame]:
    """Day arrays of each zone, and violations (zone, day, problem).

    Problems: ``rows`` (a day without exactly ``slots`` rows), ``null`` (a missing value)
    and ``absent`` (a day that another zone has and this one lacks).
    """
    per = panel.groupBy(zone, F.to_date(ts).alias("day")).agg(F.count("*").alias("_n"), F.least(*[F.count(c) for c in columns]).alias("_k") if len(columns) > 1 else F.count(columns[0]).alias("_k"))
    seen = per.withColumn("problem", F.when(F.col("_n") != slots, "rows").when(F.col("_k") != slots, "null"))
    grid = per.select(zone).distinct().crossJoin(per.select("day").distinct())  # zones and days are dimensions
    absent = grid.join(per.select(zone, "day"), [zone, "day"], "left_anti").withColumn("problem", F.lit("absent"))
    bad = seen.where("problem IS NOT NULL").select(zone, "day", "problem").unionByName(absent)
    return day_arrays(panel, [zone], columns, ts, slots), bad


def sliding_starts(df: DataFrame, keys: list[str], horizon: int = 24, ts: str = "ts", value: str = "value") -> DataFrame:
    """A sample for each starting hour with the next ``horizon`` values; the last ones, too short, are dropped."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, horizon - 1)
    return df.withColumn("target", F.collect_list(value).over(w)).where(F.size("target") == horizon)


def week_block_split(days: DataFrame, keys: list[str], share: float = 0.25, seed: int = 1) -> DataFrame:
    """Blocks of seven days in a hashed order; the last ``share`` of the blocks are validation."""
    first = Window.partitionBy(*keys)
    d = days.withColumn("block", F.floor(F.datediff("day", F.min("day").over(first)) / 7))
    b = d.select(*keys, "block").distinct()
    order = F.conv(F.substring(F.md5(F.concat_ws("|", *keys, F.col("block").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long")
    b = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "block"))).withColumn("_n", F.count("*").over(first))
    return d.join(b.select(*keys, "block", (F.col("_r") > F.col("_n") - F.floor(F.col("_n") * share)).alias("validation")), [*keys, "block"])


def training_days(days: DataFrame, refits: DataFrame, window: int, longest_lag: int = 7) -> DataFrame:
    """(refit, day): days of each refit's calibration window whose longest lag exists; months join equal months, then the range is checked."""
    first = days.agg(F.min("day").alias("_first"))
    month = lambda c: F.trunc(c, "month")
    r = refits.withColumn("_m", F.explode(F.sequence(month(F.date_sub("refit", window)), month(F.date_sub("refit", 1)), F.expr("interval 1 month"))))
    j = r.join(days.select("day").distinct().withColumn("_m", month(F.col("day"))), "_m").crossJoin(F.broadcast(first))
    return j.where((F.col("day") < F.col("refit")) & (F.col("day") >= F.date_sub("refit", window)) & (F.col("day") >= F.date_add("_first", longest_lag))).select("refit", "day")


def rolling_context(df: DataFrame, keys: list[str], days: DataFrame, context: int, ts: str = "ts", value: str = "value", past: tuple[str, ...] = (), future: tuple[str, ...] = (), horizon: int = 24) -> DataFrame:
    """(keys, day, context, ...): the last ``context`` values before each forecast day, as an array in time order.

    ``past`` columns get such an array each (``context_<c>``); ``future`` columns are known
    ahead and get the ``horizon`` values from the day on (``future_<c>``). Hours are first
    put into arrays by day, so only as many days as a context spans are copied for a
    forecast day. Days without a whole context or horizon are left out.
    """
    cols = [value, *past, *[c for c in future if c not in past]]
    at = F.struct(F.col(ts).alias("t"), *[F.col(c).alias(c) for c in cols])
    per = df.groupBy(*keys, F.to_date(ts).alias("_d")).agg(F.sort_array(F.collect_list(at)).alias("_h"))
    span, ahead = -(-context // 24) + 1, -(-horizon // 24)
    near = per.withColumn("day", F.explode(F.sequence(F.date_sub("_d", ahead - 1), F.date_add("_d", span))))
    near = near.join(days.select("day").distinct(), "day", "left_semi")
    g = near.groupBy(*keys, "day").agg(F.sort_array(F.collect_list(F.struct("_d", "_h"))).alias("_all")).withColumn("_all", F.flatten(F.transform("_all", lambda x: x["_h"])))
    start = F.col("day").cast("timestamp_ntz")
    before, after = F.filter("_all", lambda x: x["t"] < start), F.filter("_all", lambda x: x["t"] >= start)
    g = g.withColumns({"_b": F.slice(before, F.greatest(F.size(before) - context + 1, F.lit(1)), context), "_f": F.slice(after, 1, horizon)})
    g = g.where((F.size("_b") == context) & ((F.size("_f") == horizon) if future else F.lit(True)))

    def of(array: str, c: str) -> Column:
        return F.transform(array, lambda x: x[c])

    return g.select(*keys, "day", of("_b", value).alias("context"), *[of("_b", c).alias(f"context_{c}") for c in past], *[of("_f", c).alias(f"future_{c}") for c in future])
