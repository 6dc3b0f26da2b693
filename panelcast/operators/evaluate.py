"""Forecast evaluation: error metrics and tests of predictive accuracy.

Input is long: keys, stamp, observed, forecast. Rows without an observation are not scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import chi2_sf_2, norm_sf
from panelcast.operators import forecast as fc
from panelcast.operators import grid


def _r() -> Column:
    return F.col("observed")


def _p() -> Column:
    return F.col("forecast")



def mae() -> Column:
    return F.avg(F.abs(_r() - _p()))


def rmse() -> Column:
    return F.sqrt(F.avg((_r() - _p()) * (_r() - _p())))


def mape(skip_zero: bool = False) -> Column:
    """A fraction; null if an observation is 0, unless these are skipped."""
    m = F.avg(F.try_divide(F.abs(_r() - _p()), F.abs(_r())))
    return m if skip_zero else F.when(F.coalesce(F.bool_or(_r() == 0), F.lit(False)), F.lit(None)).otherwise(m)


def smape() -> Column:
    """A fraction; hours with both values 0 count 0."""
    return F.avg(F.coalesce(F.try_divide(F.abs(_r() - _p()), (F.abs(_r()) + F.abs(_p())) / 2), F.lit(0.0)))


def scores(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(_r().isNotNull() & _p().isNotNull()).groupBy(*keys).agg(mae().alias("mae"), rmse().alias("rmse"), mape().alias("mape"), smape().alias("smape"), F.count("*").alias("hours_scored"))


def naive_mae(panel: DataFrame, keys: list[str], m: str | None, ts: str = "ts", value: str = "value") -> DataFrame:
    return fc.naive_forecast(panel, keys, m, ts, value).groupBy(*keys).agg(mae().alias("naive_mae"))


def relative_mae(df: DataFrame, panel: DataFrame, keys: list[str], by: list[str], m: str | None, name: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """MAE by (keys, by) over the naive MAE of ``panel``: rMAE on the evaluated prices, MASE on in-sample ones."""
    s = df.where(_r().isNotNull() & _p().isNotNull()).groupBy(*keys, *by).agg(mae().alias("mae"))
    return s.join(naive_mae(panel, keys, m, ts, value), keys).select(*keys, *by, (F.col("mae") / F.col("naive_mae")).alias(name))


def losses(df: DataFrame, norm: int) -> DataFrame:
    return df.withColumn("loss", F.abs(_r() - _p()) if norm == 1 else (_r() - _p()) * (_r() - _p()))


def loss_pairs(df: DataFrame, keys: list[str], at: list[str], norm: int = 1, member: str = "member") -> DataFrame:
    """(keys, at, a, b, d): difference of losses of each ordered pair of members at each stamp, all pairs in one join."""
    x = losses(df.where(_r().isNotNull() & _p().isNotNull()), norm)
    a = x.select(*keys, *at, F.col(member).alias("a"), F.col("loss").alias("_la"))
    b = x.select(*keys, *at, F.col(member).alias("b"), F.col("loss").alias("_lb"))
    return a.join(b, [*keys, *at]).where("a <> b").withColumn("d", F.col("_la") - F.col("_lb")).drop("_la", "_lb")


def dm_test(d: DataFrame, by: list[str]) -> DataFrame:
    """Diebold-Mariano statistic mean / sqrt(var / N) and its upper tail; null when the difference never varies. Small p favours b."""
    g = d.groupBy(*by).agg(F.avg("d").alias("_m"), F.var_pop("d").alias("_v"), F.count("*").alias("n"))
    stat = F.when(F.col("_v") > 0, F.col("_m") / F.sqrt(F.col("_v") / F.col("n")))
    return g.withColumn("stat", stat).withColumn("p_value", norm_sf("stat")).drop("_m", "_v")


def daily_losses(d: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Mean difference of a day's hours: the multivariate versions' input."""
    return d.groupBy(*by, day).agg(F.avg("d").alias("d"))


def gw_test(d: DataFrame, by: list[str], order: str, sign_of_all: bool = True) -> DataFrame:
    """Giacomini-White: T R^2 of ones on d_t and d_t d_(t-1), signed by the mean of d (of all days, or of those regressed)."""
    w = Window.partitionBy(*by).orderBy(order)
    x = d.withColumn("_l", F.lag("d").over(w)).withColumn("_z", F.col("d") * F.col("_l"))
    z1 = F.when(F.col("_l").isNotNull(), F.col("d"))
    g = x.groupBy(*by).agg(F.sum(z1).alias("_sa"), F.sum("_z").alias("_sb"), F.sum(z1 * z1).alias("c11"), F.sum(z1 * F.col("_z")).alias("c12"), F.sum(F.col("_z") * F.col("_z")).alias("c22"), F.avg("d" if sign_of_all else z1).alias("_m"))
    det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
    a, b = F.col("_sa"), F.col("_sb")
    stat = (a * a * F.col("c22") - 2 * a * b * F.col("c12") + b * b * F.col("c11")) / F.nullif(det, F.lit(0.0))
    g = g.withColumn("stat", F.when(det > 0, stat * F.signum("_m")))
    return g.withColumn("p_value", F.when(F.col("stat").isNotNull(), chi2_sf_2(F.col("stat")))).select(*by, "stat", "p_value")


def gw_unconditional(d: DataFrame, by: list[str]) -> DataFrame:
    """(sum d)^2 / sum d^2, signed; chi-square with one degree of freedom."""
    g = d.groupBy(*by).agg(F.sum("d").alias("_s"), F.sum(F.col("d") * F.col("d")).alias("_q"))
    g = g.withColumn("stat", F.try_divide(F.col("_s") * F.col("_s"), F.col("_q")) * F.signum("_s"))
    return g.withColumn("p_value", F.when(F.col("stat") >= 0, 2 * norm_sf(F.sqrt("stat"))).when(F.col("stat").isNotNull(), F.lit(1.0))).drop("_s", "_q")


def compare(d: DataFrame, by: list[str], day: str = "day", least: int = 24) -> DataFrame:
    """Both multivariate tests with a reason where they cannot be told."""
    days = daily_losses(d, by, day)
    n = days.groupBy(*by).agg(F.count("*").alias("days"), F.max(F.abs("d")).alias("_top"))
    dm, gw = dm_test(days, by).select(*by, F.col("stat").alias("dm_stat"), F.col("p_value").alias("dm_p")), gw_test(days, by, day, False).select(*by, F.col("stat").alias("gw_stat"), F.col("p_value").alias("gw_p"))
    j = n.join(dm, by).join(gw, by)
    why = F.when(F.col("_top") == 0, "identical forecasts").when(F.col("days") < least, "too few days").when(F.col("dm_stat").isNull() | F.col("gw_stat").isNull(), "degenerate")
    return j.withColumn("reason", why).withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("dm_stat", "dm_p", "gw_stat", "gw_p")}).drop("_top")


def pairwise_matrix(tests: DataFrame, keys: list[str], members: list[str], p: str = "p_value") -> DataFrame:
    """One row for each member a and one column for each member b: the p value of the test of (a, b), 1 on the diagonal, null where it is missing."""
    m = F.explode(F.array(*[F.lit(x) for x in members]))
    own = tests.select(*keys).distinct().withColumn("a", m).select(*keys, "a", F.col("a").alias("b"), F.lit(1.0).alias(p))
    return tests.where("a <> b").select(*keys, "a", "b", p).unionByName(own).groupBy(*keys, "a").pivot("b", members).agg(F.first(p))


def evaluate_run(members: DataFrame, keys: list[str], ts: str = "ts", member: str = "member", slots: int = 24, least: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, tests, predictions) of a run of several members (keys, ts, day, slot, member, observed, forecast).

    The ensemble is the mean of the days that all members have whole. Scores by member
    and for the ensemble are on these days; tests compare each pair, the ensemble among
    them, on those of the days that are observed whole; predictions are the ensemble's hours.
    """
    n = members.groupBy(*keys).agg(F.count_distinct(member).alias("_all"))
    whole = fc.complete_days(members, [*keys, member], slots).groupBy(*keys, "day").agg(F.count("*").alias("_k"))
    days = whole.join(n, keys).where("_k = _all").select(*keys, "day")
    own = members.join(days, [*keys, "day"], "left_semi")
    at = [*keys, ts, "day", "slot"]
    e = own.groupBy(*at).agg(F.avg("forecast").alias("forecast"), F.max("observed").alias("observed"))
    cols = [*at, member, "forecast", "observed"]
    every = own.select(cols).unionByName(e.withColumn(member, F.lit("ensemble")).select(cols))
    seen = e.groupBy(*keys, "day").agg(F.count("observed").alias("_n")).where(F.col("_n") == slots)
    pairs = loss_pairs(every.join(seen, [*keys, "day"], "left_semi").drop(ts), keys, ["day", "slot"], 1, member)
    return scores(every, [*keys, member]), compare(pairs, [*keys, "a", "b"], least=least), e.select(*keys, ts, "forecast", "observed")


def real_prices(df: DataFrame, keys: list[str], days: DataFrame, ts: str = "ts", value: str = "value", slots: int = 24) -> DataFrame:
    """(keys, day, slots): the actual values of the days asked for, as arrays by hour; missing hours are null."""
    return grid.day_matrix(df, keys, ts, value, slots).join(days.select("day").distinct(), "day", "left_semi")


def model_vs_model(a: DataFrame, b: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """MAE of two prediction tables on the observed hours that both have, by ``keys`` (of ``on``)."""
    x = a.where(_r().isNotNull() & _p().isNotNull()).select(*on, "observed", F.col("forecast").alias("_fa"))
    j = x.join(b.where(_p().isNotNull()).select(*on, F.col("forecast").alias("_fb")), on)
    return j.groupBy(*keys).agg(F.count("*").alias("hours"), F.avg(F.abs(_r() - F.col("_fa"))).alias("mae_a"), F.avg(F.abs(_r() - F.col("_fb"))).alias("mae_b"))


def hours_scored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hours with and without an observation, and the MAE of the former."""
    return df.where(_p().isNotNull()).groupBy(*keys).agg(F.count("observed").alias("hours_scored"), (F.count("*") - F.count("observed")).alias("hours_unobserved"), mae().alias("mae"))


def running_metrics(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """MAE and sMAPE of all hours up to each day."""
    e = F.abs(_r() - _p())
    g = df.groupBy(*keys, day).agg(F.sum(e).alias("_e"), F.sum(F.try_divide(e, (F.abs(_r()) + F.abs(_p())) / 2)).alias("_s"), F.count(e).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*keys, day, (F.sum("_e").over(w) / F.sum("_n").over(w)).alias("mae"), (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("smape"))


def normalised_mae(df: DataFrame, zone: str, slot: Column) -> DataFrame:
    """MAE of each zone, its mean over slots of the observations' scaled median absolute deviation, and their ratio."""
    x = df.where(_r().isNotNull() & _p().isNotNull()).withColumn("_h", slot)
    med = x.groupBy(zone, "_h").agg(F.median("observed").alias("_med"))
    mad = x.join(med, [zone, "_h"]).groupBy(zone, "_h").agg((F.median(F.abs(_r() - F.col("_med"))) / 0.6744897501960817).alias("_mad")).groupBy(zone).agg(F.avg("_mad").alias("scale"))
    m = x.groupBy(zone).agg(mae().alias("mae")).join(mad, zone).withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    return m.withColumn("normalised", F.col("mae") / F.col("scale"))


def timing_summary(df: DataFrame, keys: list[str], seconds: str = "seconds") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("fits"), F.avg(seconds).alias("mean"), F.stddev_samp(seconds).alias("sd"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.sum(seconds).alias("total"))


def backtest_progress(done: DataFrame, run: str, member: str, members: int, total_days: int, seconds: str = "seconds", last: int = 20) -> DataFrame:
    """Per run: days that all members have finished, members on the latest day, seconds a day over the latest ``last`` days, share done and seconds left."""
    d = done.groupBy(run, "day").agg(F.count_distinct(member).alias("_k"), F.sum(seconds).alias("_s"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("day"))))
    g = d.groupBy(run).agg(F.sum((F.col("_k") >= members).cast("int")).alias("days_done"), F.max(F.when(F.col("_r") == 1, F.col("_k"))).alias("members_on_latest"), F.avg(F.when(F.col("_r") <= last, F.col("_s"))).alias("seconds_per_day"))
    return g.withColumn("pct_done", 100 * F.col("days_done") / total_days).withColumn("seconds_left", (total_days - F.col("days_done")) * F.col("seconds_per_day"))
