"""Forecast jobs: naive forecasts, refit schedules, walk-forward LASSO as one grouped Spark job."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources import dataset
from panelcast.sources.scratch import stage


def naive_forecast(df: DataFrame, keys: list[str], m: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """The value of an earlier day at the same time: 'D' the day before, 'W' the week before, None the week before on Monday, Saturday and Sunday and the day before else. Stamps whose source is missing are absent."""
    days = {"D": [1], "W": [7], None: [1, 7]}[m]
    out = None
    for k in days:
        src = df.select(*keys, (F.col(ts) + F.expr(f"interval {k} days")).alias(ts), F.col(value).alias("forecast"))
        if m is None:
            weekend = F.weekday(ts).isin(0, 5, 6)
            src = src.where(weekend if k == 7 else ~weekend)
        out = src if out is None else out.unionByName(src)
    return df.select(*keys, ts, F.col(value).alias("observed")).join(out, [*keys, ts])


def refit_day(day: Column, begin: Column, cadence: int) -> Column:
    """The refit that serves a day, on a grid fixed by ``begin``."""
    return F.date_add(begin, (F.floor(F.datediff(day, begin) / cadence) * cadence).cast("int"))


def ensemble_mean(members: DataFrame, keys: list[str], member: str = "member", forecast: str = "forecast") -> DataFrame:
    """Mean over the stamps that all members have."""
    n = members.agg(F.count_distinct(member).alias("_n"))
    g = members.groupBy(*keys).agg(F.avg(forecast).alias("ensemble"), F.count(forecast).alias("_k"))
    return g.crossJoin(F.broadcast(n)).where("_k = _n").drop("_k", "_n")


def complete_days(forecasts: DataFrame, keys: list[str], slots: int = 24) -> DataFrame:
    return forecasts.groupBy(*keys, "day").agg(F.count("forecast").alias("_n")).where(F.col("_n") == slots).drop("_n")


def resume_pending(days: DataFrame, forecasts: DataFrame, keys: list[str], slots: int = 24) -> DataFrame:
    """Days that are still to do: only complete days count as done."""
    return days.join(complete_days(forecasts, keys, slots), [*keys, "day"], "left_anti")


def run_backtest(path: str, wanted: DataFrame, forecast: Callable[[DataFrame], DataFrame], parts: list[str], at_once: int = 64) -> DataFrame:
    """Forecasts of all ``wanted`` blocks (``parts``: zone, window, block), those that a run before has committed read from ``path``.

    Pending blocks are found by an anti join and computed ``at_once`` at a time: ``forecast``
    maps their rows to rows of forecasts that carry ``parts``, and each lot is committed as
    a whole. A run that is killed loses the lot it was at; one that is started again does
    the rest. Returns everything committed so far.
    """
    spark = wanted.sparkSession
    todo = wanted.select(parts).distinct()
    if dataset.exists(spark, path):
        todo = todo.join(dataset.read(spark, path).select(parts).distinct(), parts, "left_anti")
    nth = F.row_number().over(Window.orderBy(*parts)) - 1  # blocks, not rows
    todo = stage(todo.withColumn("_lot", F.floor(nth / at_once)), "pending")
    for lot in range((todo.agg(F.max("_lot").alias("n")).first()["n"] or 0) + 1 if todo.limit(1).count() else 0):
        dataset.append(forecast(todo.where(F.col("_lot") == lot).drop("_lot")), path, parts)
    return dataset.read(spark, path)


def feasible_windows(df: DataFrame, windows: list[int], ts: str = "ts", test_days: int = 728, floor: int = 56) -> DataFrame:
    """Test range (its last ``test_days`` days) and which calibration windows fit before it."""
    b = df.agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("end")).withColumn("begin", F.date_sub("end", test_days - 1))
    w = F.explode(F.array(*[F.lit(x) for x in windows])).alias("window")
    return b.select("first", "begin", "end", w).withColumn("fits", (F.col("window") >= floor) & (F.date_sub("begin", F.col("window")) >= F.col("first")))


def no_overlap(search_end: Column, test_begin: Column) -> Column:
    """Whether a hyper-parameter search that ends on a day sees nothing of the test range."""
    return search_end < test_begin


def search_window(df: DataFrame, test_begin: str, years: int, ts: str = "ts") -> DataFrame:
    """(begin, end, first, days, disjoint): the search's validation range is the ``364 * years`` days before the test range; ``first`` is the panel's first day and ``days`` what is left to train on."""
    b = F.lit(test_begin).cast("date")
    g = df.agg(F.min(F.to_date(ts)).alias("first")).withColumns({"begin": F.date_sub(b, 364 * years), "end": F.date_sub(b, 1)})
    return g.select("begin", "end", "first", F.datediff("begin", "first").alias("days"), no_overlap(F.col("end"), b).alias("disjoint"))


class _Active:
    """The active columns of a LASSO path and the inverse of their part of the Gram matrix, which is updated as columns come and go."""

    def __init__(self, gram: np.ndarray):
        self.gram, self.at, self.changes = gram, [], 0
        self.inv = np.empty_like(gram)
        self.slack = 1e-12 * max(float(gram.diagonal().max()), 1e-300) if len(gram) else 0.0

    def inverse(self) -> np.ndarray:
        return self.inv[: len(self.at), : len(self.at)]

    def add(self, j: int) -> bool:
        """False if the column is a combination of the active ones."""
        k, inv = len(self.at), self.inverse()
        g = self.gram[self.at, j]
        u = inv @ g
        s = float(self.gram[j, j]) + self.slack - float(g @ u)
        if s <= 1e-10 * float(self.gram[j, j]) + 2 * self.slack:
            return False
        inv += np.outer(u, u / s)
        self.inv[:k, k] = self.inv[k, :k] = -u / s
        self.inv[k, k] = 1 / s
        self.at.append(j)
        self._refresh()
        return True

    def drop(self, i: int) -> int:
        inv, k = self.inverse(), len(self.at)
        col = inv[:, i].copy()
        keep = np.delete(np.arange(k), i)
        self.inv[: k - 1, : k - 1] = (inv - np.outer(col, col / col[i]))[np.ix_(keep, keep)]
        j = self.at.pop(i)
        self._refresh()
        return j

    def _refresh(self) -> None:
        self.changes += 1
        if self.changes % 64 == 0:  # against drift
            k = len(self.at)
            self.inv[:k, :k] = np.linalg.inv(self.gram[np.ix_(self.at, self.at)] + self.slack * np.eye(k))


def lars_path(gram: np.ndarray, xy: np.ndarray, most: int = 2500) -> np.ndarray:
    """Weights at every knot of the LASSO path, one row each, from X'X and X'y of centred columns."""
    p = len(xy)
    w, c, path, banned = np.zeros(p), xy.astype(float).copy(), [np.zeros(p)], False
    active, free = _Active(gram), np.ones(p, bool)
    top = np.abs(c).max() if p else 0.0
    eps = 1e-10 * max(top, 1e-300)
    for _ in range(most):
        cmax = np.abs(c[active.at]).max() if active.at else top
        if cmax <= eps:
            break
        if not banned and free.any():
            j = int(np.argmax(np.where(free, np.abs(c), -1.0)))
            if abs(c[j]) >= cmax * (1 - 1e-9):
                free[j] = False
                if not active.add(j):
                    continue
        if not active.at:
            break
        at, banned = active.at, False
        cmax = np.abs(c[at]).max()
        d = np.zeros(p)
        d[at] = active.inverse() @ np.sign(c[at])
        a, step = gram @ d, cmax
        if free.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                q = np.concatenate([((cmax - c) / (1 - a))[free], ((cmax + c) / (1 + a))[free]])
            q = q[np.isfinite(q) & (q > 1e-12 * cmax)]
            if len(q):
                step = min(step, q.min())
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = -w[at] / d[at]
        hit = np.flatnonzero(np.isfinite(cross) & (cross > 1e-14) & (cross < step))
        if len(hit):
            banned, i = True, int(hit[np.argmin(cross[hit])])
            step = cross[i]
        w = w + step * d
        c = c - step * a
        if banned:
            j = active.drop(i)
            w[j], free[j] = 0.0, True
        path.append(w)
        if step >= cmax * (1 - 1e-12):
            break
    return np.stack(path)


def lasso_by_aic(x: np.ndarray, ys: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each column y of ``ys`` weights and intercept at the knot of least n log(2 pi s2) + RSS / s2 + 2 df, with s2 the variance of y; X'X is shared."""
    mx = x.mean(0)
    xc = x - mx
    g, out = xc.T @ xc, []
    for y in ys.T:
        my = y.mean()
        yc = y - my
        s2 = float(yc @ yc) / len(y)
        if s2 <= 0:
            out.append((np.zeros(x.shape[1]), float(my)))
            continue
        xy = xc.T @ yc
        path = lars_path(g, xy)
        rss = float(yc @ yc) - 2 * path @ xy + ((path @ g) * path).sum(1)
        w = path[int(np.argmin(rss / s2 + 2 * (np.abs(path) > 1e-12).sum(1)))]
        out.append((w, float(my - mx @ w)))
    return out


def _invariant(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    med = np.median(v, 0)
    mad = np.median(np.abs(v - med), 0) / 0.6744897501960817
    return med, np.where(mad == 0, 1.0, mad)


def walk_forward_lasso(features: DataFrame, keys: list[str], windows: list[int], begin: str | None = None, end: str | None = None, block: int = 14, dummies: int = 7, longest_lag: int = 7, cadence: int = 1, every: int = 1) -> DataFrame:
    """(keys, window, day, slot, forecast) of each test day from a fit on the days of the calibration window before it.

    ``features`` has one row for each key and day: features (the last ``dummies`` are
    not scaled) and target arrays. Test days run from ``begin`` to ``end``, each
    ``every``-th; by default from the first day that all windows fit before to the
    panel's last (one pass over the days). With a ``cadence`` (a divisor of a block's
    span) one fit serves that many days, on a grid that starts with ``begin``; features
    stay those of each day. A group is one key, window and block of about ``block`` days
    from its first to its last test day; it gets the rows of its windows once and slides
    inside the task, so rows are copied about window / block times, not window times, and
    a group is as large as one window whatever the panel's length.
    """
    per = max(1, block // every)
    span = per * every
    if span % cadence:
        raise ValueError("the cadence must divide the block")
    if begin is None or end is None:
        seen = features.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        if seen["a"] is not None:
            begin = begin or str(seen["a"] + timedelta(days=max(windows) - longest_lag))
            end = end or str(seen["b"])
        else:
            begin = end = "1970-01-01"
    first, last = F.lit(begin).cast("date"), F.lit(end).cast("date")
    w = F.explode(F.array(*[F.lit(x) for x in windows])).alias("window")
    r = features.select(*keys, "day", "features", "target", w)
    at = F.datediff("day", first)
    lo = F.greatest(F.lit(0), F.floor(F.ceil(at / every) / per))
    hi = F.least(F.floor(F.datediff(last, first) / span), F.floor((at + F.col("window")) / span))
    r = r.where((F.col("day") <= last) & (hi >= lo)).withColumn("block", F.explode(F.sequence(lo, hi)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        days = pd.to_datetime(pdf["day"]).to_numpy().astype("datetime64[D]")
        x, y = np.stack(pdf["features"].to_numpy()), np.stack(pdf["target"].to_numpy())
        window, b = int(pdf["window"].iloc[0]), int(pdf["block"].iloc[0])
        start = np.datetime64(begin) + b * span
        cont, out = x.shape[1] - dummies, []
        fits: dict = {}
        test = (days >= start) & (days < start + span) & (days <= np.datetime64(end)) & ((days - start).astype(int) % every == 0)
        for day in days[test]:
            refit = start + int((day - start).astype(int)) // cadence * cadence
            if refit not in fits:
                at = (days < refit) & (days >= refit - window + longest_lag)
                if at.sum() < 2:
                    fits[refit] = None
                    continue
                (mx, sx), (my, sy) = _invariant(x[at][:, :cont]), _invariant(y[at])
                scaled = np.concatenate([np.arcsinh((x[at][:, :cont] - mx) / sx), x[at][:, cont:]], 1)
                fits[refit] = (mx, sx, my, sy, lasso_by_aic(scaled, np.arcsinh((y[at] - my) / sy)))
            if fits[refit] is None:
                continue
            mx, sx, my, sy, models = fits[refit]
            raw = x[days == day][0]
            now = np.concatenate([np.arcsinh((raw[:cont] - mx) / sx), raw[cont:]])
            for h, (coef, icpt) in enumerate(models):
                out.append((*[pdf[k].iloc[0] for k in keys], window, day.astype(object), h, float(np.sinh(now @ coef + icpt) * sy[h] + my[h])))
        return pd.DataFrame(out, columns=[*keys, "window", "day", "slot", "forecast"])

    kinds = dict(features.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "window int, day date, slot int, forecast double"])
    return r.groupBy(*keys, "window", "block").applyInPandas(run, schema)


def walk_forward_ols(df: DataFrame, keys: list[str], x: str, y: str, window: int, day: str = "day", at: str = "slot") -> DataFrame:
    """Adds ``forecast``: y on x by least squares over the ``window`` days before each row's day.

    Sums of products are formed by day and then over a range of days, so no row is
    copied for the windows it lies in.
    """
    cx, cy = F.col(x), F.col(y)
    both = cx.isNotNull() & cy.isNotNull()
    s = df.where(both).groupBy(*keys, day).agg(F.count("*").alias("_n"), F.sum(cx).alias("_x"), F.sum(cy).alias("_y"), F.sum(cx * cx).alias("_xx"), F.sum(cx * cy).alias("_xy"))
    days = df.select(*keys, day).distinct().join(s, [*keys, day], "left").withColumn("_d", F.datediff(day, F.lit("1970-01-01")))
    w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-window, -1)
    t = {c: F.sum(c).over(w) for c in ("_n", "_x", "_y", "_xx", "_xy")}
    slope = (t["_n"] * t["_xy"] - t["_x"] * t["_y"]) / F.nullif(t["_n"] * t["_xx"] - t["_x"] * t["_x"], F.lit(0.0))
    fit = days.withColumn("_slope", slope).withColumn("_icpt", (t["_y"] - F.col("_slope") * t["_x"]) / t["_n"]).select(*keys, day, "_slope", "_icpt")
    return df.join(fit, [*keys, day]).withColumn("forecast", F.col("_icpt") + F.col("_slope") * cx).drop("_slope", "_icpt")
