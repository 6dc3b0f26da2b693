"""Imputation with an audit trail. Panels are on their complete grid, gaps null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import carry, gram, grid

#: Seconds of a bucket of a chain that has one row a week.
CHAIN = 168 * carry.WIDTH


def hour_index(ts: Column) -> Column:
    return F.floor(grid.seconds(ts) / 3600)


def weekly_lag_fill(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", period: int = 168) -> DataFrame:
    """A missing hour takes the latest earlier value a whole number of periods before it: the recursion t - 168 h in closed form.

    Hours with no such value stay null; ``unfilled`` lists them.
    """
    d = df.withColumn("_slot", hour_index(F.col(ts)) % period)
    d = carry.scan(d, [*keys, "_slot"], ts, back={"filled": F.col(value)}, width=CHAIN)
    return d.withColumn("imputed", F.col(value).isNull() & F.col("filled").isNotNull()).withColumn("imputation_method", F.when(F.col("imputed"), "weekly_lag")).drop("_slot")


def unfilled(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "filled") -> DataFrame:
    """Keys with values that no rule could fill: their number and the first stamp."""
    return df.where(F.col(value).isNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(ts).alias("first"))


def ffill_short(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", most: int = 3) -> DataFrame:
    """Forward fill of runs of nulls that close within ``most`` rows; others stay null."""
    d = carry.scan(df, keys, ts, back={"_p": F.col(value)}, ahead={"_q": F.col(value)}, position="_n")
    ok = F.col("_q_at") - F.col("_p_at") - 1 <= most
    return d.withColumn("filled", F.coalesce(F.col(value), F.when(ok, F.col("_p")))).drop("_n", "_p", "_p_at", "_q", "_q_at")


def fill_by_shift(df: DataFrame, keys: list[str], step: int, passes: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Pass k takes the value ``step * k`` hours earlier, reading the series as the passes before left it.

    Hours that are a multiple of ``step`` apart form a chain. An hour depends on those
    of the last ``step * (1 + ... + passes)`` alone, so chains are cut into buckets of
    four times as long, each with a copy of what its first hours depend on.
    """
    reach = step * passes * (passes + 1) // 2
    hour, span = hour_index(F.col(ts)), 4 * reach
    own = F.floor(hour / span)
    places = F.when(hour - own * span >= span - reach, F.array(own, own + 1)).otherwise(F.array(own))
    d = df.withColumns({"_chain": hour % step, "_own": own}).withColumn("_bucket", F.explode(places))
    w = Window.partitionBy(*keys, "_chain", "_bucket").orderBy(ts)
    for k in range(1, passes + 1):
        d = d.withColumn(value, F.coalesce(F.col(value), F.lag(value, k).over(w)))
    return d.where("_own <=> _bucket").drop("_chain", "_own", "_bucket")


def prefix_medians(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Medians of the first ``n`` values for each n of ``lengths``; NaN for none.

    Values are coded by rank, and the ranks are split by their bits from the highest on: at
    each bit, counts of zeros tell all questions at once in which half their answer lies.
    """
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    at = np.repeat(lengths.astype(np.int64), 2)
    k = (at - 1) // 2
    k[1::2] = at[1::2] // 2  # the two in the middle
    lo, hi, found = np.zeros_like(at), at.copy(), np.zeros_like(at)
    k = np.where(at > 0, k, 0)
    for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
        ones = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        a, b = zeros[lo], zeros[hi]
        left = k < b - a
        found |= np.where(left, 0, 1 << bit)
        k = np.where(left, k, k - (b - a))
        lo, hi = np.where(left, a, zeros[-1] + lo - a), np.where(left, b, zeros[-1] + hi - b)
        rank = np.concatenate([rank[~ones], rank[ones]])
    if not len(values):
        return np.full(len(lengths), np.nan)
    got = np.where(at > 0, values[order][np.minimum(found, len(values) - 1)], np.nan).reshape(-1, 2)
    return np.where(lengths % 2 == 1, got[:, 0], (got[:, 0] + got[:, 1]) / 2)


def expanding_hour_median(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Nulls take the median of all earlier values at their hour of day.

    Only hours of keys that have a gap are sent to a task: one value for each day of a
    key's history, and all gaps of a group are answered at once (``prefix_medians``).
    """
    d = df.withColumn("_h", F.hour(ts))
    gaps = d.where(F.col(value).isNull()).select(*keys, "_h").distinct()
    kinds = dict(d.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        v = pdf[value].to_numpy()
        gap = np.isnan(v)
        before = np.cumsum(~gap)[gap]
        got = pdf.loc[gap, [*keys, ts]]
        got["_m"] = prefix_medians(v[~gap], before)
        return got[before > 0]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, ts]), "_m double"])
    med = d.join(gaps, [*keys, "_h"], "left_semi").select(*keys, "_h", ts, F.col(value).cast("double").alias(value)).groupBy(*keys, "_h").applyInPandas(run, schema)
    return d.join(med, [*keys, ts], "left").withColumn("filled", F.coalesce(value, "_m")).drop("_h", "_m")


def impute_cascade(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Short forward fill, weekly shifts, daily shifts, hour medians; ``method`` names the pass. Leading nulls may stay."""
    d = ffill_short(df, keys, ts, value).withColumn("_orig", F.col(value)).withColumn(value, F.col("filled")).drop("filled").withColumn("_a", F.col(value))
    d = fill_by_shift(d, keys, 168, 8, ts, value).withColumn("_b", F.col(value))
    d = fill_by_shift(d, keys, 24, 6, ts, value).withColumn("_c", F.col(value))
    d = expanding_hour_median(d, keys, ts, value)
    m = F.when(F.col("_orig").isNotNull(), "observed").when(F.col("_a").isNotNull(), "ffill").when(F.col("_b").isNotNull(), "weekly_shift").when(F.col("_c").isNotNull(), "daily_shift").when(F.col("filled").isNotNull(), "hour_median").otherwise("unfilled")
    return d.withColumn("method", m).withColumn(value, F.col("filled")).drop("_orig", "_a", "_b", "_c", "filled")


def row_for_fill(df: DataFrame, keys: list[str], meta: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Metadata of inserted rows: the row a week before, else the latest earlier one."""
    d = df.withColumn("_m", F.when(F.col(value).isNotNull(), F.struct(*meta))).withColumn("_slot", hour_index(F.col(ts)) % 168)
    d = carry.scan(d, [*keys, "_slot"], ts, before={"_week": F.struct("_m")}, width=CHAIN)
    d = carry.scan(d, keys, ts, before={"_last": F.col("_m")})
    d = d.withColumn("_m", F.coalesce("_m", "_week._m", "_last")).drop(*meta, "_slot", "_week", "_last")
    return d.select("*", *[F.col(f"_m.{c}").alias(c) for c in meta]).drop("_m")


def route_fill(df: DataFrame, variable: str, rules: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each variable's rows through its rule; a variable without a rule is an error."""
    filters_left = df.where(~F.col(variable).isin(*rules)).select(variable).distinct().limit(1).collect()
    if filters_left:
        raise ValueError(f"no rule to fill {filters_left[0][0]}")
    out = None
    for v, f in rules.items():
        part = f(df.where(F.col(variable) == v))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def trim_to_first_complete_day(df: DataFrame, keys: list[str], series: str, ts: str = "ts", value: str = "value", slots: int = 24) -> DataFrame:
    """From the first day on which every series of the keys has all its slots."""
    days = df.groupBy(*keys, F.to_date(ts).alias("_d"), series).agg((F.count(value) == slots).alias("_ok"))
    n = df.groupBy(*keys).agg(F.count_distinct(series).alias("_n"))
    first = days.groupBy(*keys, "_d").agg(F.sum(F.col("_ok").cast("int")).alias("_k")).join(n, keys).where("_k = _n").groupBy(*keys).agg(F.min("_d").alias("_first"))
    return df.join(first, keys).where(F.to_date(ts) >= F.col("_first")).drop("_first")


def cross_series_ols_fill(df: DataFrame, series: str, ts: str = "ts", value: str = "value", least: int = 672, kind: str | None = None) -> DataFrame:
    """Each run of nulls from an intercept regression on the other series that are complete over it, fitted on all earlier rows where these are complete.

    With ``kind`` only series of the same kind predict each other. Rows are put into one
    map by kind and stamp (series are few, stamps many); each series and set of predictors
    has one matrix of sums of products for each bucket of its history, which is met once,
    not for each run; a task solves a system as wide as the number of series. Runs without predictors or with fewer than ``least`` rows stay
    null; values are at least 0.
    """
    k = F.lit("") if kind is None else F.col(kind)
    d = df.select(F.col(series).alias("s"), k.alias("k"), F.col(ts).alias("t"), F.col(value).alias("v"))
    # a run's number is the row of the last value before it, 0 at a series' start
    runs = carry.scan(d, ["s"], "t", back={"p": F.col("v")}, position="i").where("v IS NULL").withColumn("run", F.coalesce("p_at", F.lit(0))).drop("p", "p_at", "i")
    rows = runs.select("k", "s", "run", "t")
    runs = rows.groupBy("k", "s", "run").agg(F.min("t").alias("a"), F.count("*").alias("n"))
    # all series of a kind at a stamp, as one map
    at = d.where("v IS NOT NULL").groupBy("k", "t").agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("x"))
    here = rows.join(at, ["k", "t"])
    full = here.select("k", "s", "run", F.explode(F.map_keys("x")).alias("p")).groupBy("k", "s", "run", "p").agg(F.count("*").alias("c"))
    preds = full.join(runs, ["k", "s", "run"]).where("c = n AND p <> s").groupBy("k", "s", "run", "a").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def vector(last: Column | None) -> Column:
        return F.concat(F.array(F.lit(1.0)), F.transform("ps", lambda p: F.try_element_at("x", p)), *([] if last is None else [F.array(last)]))

    # runs of one series with the same predictors share their history
    own = F.to_json(F.struct("k", "s", "ps"))
    preds = preds.withColumn("own", own)
    sets = preds.select("own", "k", "s", "ps").distinct()
    z = sets.join(at, "k").select("own", "t", vector(F.try_element_at("x", F.col("s"))).alias("z")).where(~F.exists("z", lambda e: e.isNull()))

    def solve(g: np.ndarray) -> dict:
        beta = np.full(len(g) - 1, np.nan) if g[0, 0] < least else np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        return {"beta": beta.tolist(), "rows": int(g[0, 0])}

    fit = gram.rolling_gram(z, preds.select("own", "run", "a"), "own", "t", "z", "a", solve, "beta array<double>, rows long")
    fit = fit.join(sets.select("own", "k", "s"), "own").drop("own")
    now = here.join(preds.drop("a", "own"), ["k", "s", "run"]).join(fit, ["k", "s", "run"])
    dot = F.aggregate(F.zip_with(vector(None), "beta", lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x)
    got = now.select(F.col("s").alias(series), F.col("t").alias(ts), F.when(F.col("rows") >= least, F.greatest(dot, F.lit(0.0))).alias("_f"), F.col("ps").alias("_p"))
    out = df.join(got, [series, ts], "left")
    hit = F.col(value).isNull() & F.col("_f").isNotNull()
    return out.withColumns({"filled": F.coalesce(value, "_f"), "imputed": hit, "imputation_method": F.when(hit, "ols"), "imputation_predictors": F.when(hit, F.col("_p"))}).drop("_f", "_p")
