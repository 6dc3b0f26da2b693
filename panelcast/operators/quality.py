"""Data-quality audits: aggregate reports of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import carry, grid


def duplicate_audit(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Keys with more than one row: copies, distinct values and their spread."""
    g = df.groupBy(*key).agg(F.count("*").alias("copies"), F.count_distinct(value).alias("distinct_values"), (F.max(value) - F.min(value)).alias("spread"))
    return g.where("copies > 1")


def duplicates_by_series(audit: DataFrame, series: list[str], ts: str) -> DataFrame:
    """Of each series: repeated stamps, rows to drop, stamps whose copies disagree, largest spread, first and last stamp."""
    return audit.groupBy(*series).agg(
        F.count("*").alias("stamps"),
        F.sum(F.col("copies") - 1).alias("redundant"),
        F.sum((F.col("distinct_values") > 1).cast("int")).alias("disagreeing"),
        F.max("spread").alias("max_spread"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
    )


def copies_histogram(audit: DataFrame) -> DataFrame:
    """How many keys stand how often."""
    return audit.groupBy("copies").agg(F.count("*").alias("keys"))


def duplicates_by_day_of_month(audit: DataFrame, ts: str) -> DataFrame:
    """Repeated keys by day of month: overlapping downloads show at its ends."""
    return audit.groupBy(F.dayofmonth(ts).alias("day_of_month")).agg(F.count("*").alias("keys"), F.sum(F.col("copies") - 1).alias("redundant"))


def dedupe(df: DataFrame, key: list[str], seq: str, value: str) -> DataFrame:
    """First row of each key by (seq, value): a partial minimum, no sort of whole keys."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(seq, value)).alias("_r")).select(*key, "_r.*")


def intra_hour_variation(df: DataFrame, series: list[str], ts: str = "ts", value: str = "value", tol: float = 1e-9) -> DataFrame:
    """For each series the hours with several slots, those that vary, the largest spread, first varying hour and shares."""
    h = df.groupBy(*series, grid.hour_of(F.col(ts)).alias("hour")).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread"), F.max(F.abs(value)).alias("top"))
    var, act = F.col("spread") > tol, F.col("top") > tol
    g = h.where("n > 1").groupBy(*series).agg(
        F.count("*").alias("hours"),
        F.sum(var.cast("int")).alias("varying"),
        F.sum((~act).cast("int")).alias("inactive"),
        F.max("spread").alias("max_spread"),
        F.min("hour").alias("first"),
        F.max("hour").alias("last"),
        F.min(F.when(var, F.col("hour"))).alias("first_varying"),
    )
    return g.withColumn("pct_varying", 100 * F.col("varying") / F.col("hours")).withColumn("pct_of_active", 100 * F.try_divide(F.col("varying"), F.col("hours") - F.col("inactive")))


def monthly_variation_share(df: DataFrame, series: str, values: list[str], ts: str = "ts", value: str = "value", tol: float = 1e-9) -> DataFrame:
    h = df.groupBy(series, grid.hour_of(F.col(ts)).alias("hour")).agg((F.max(value) - F.min(value)).alias("spread"))
    return h.groupBy(F.date_format("hour", "yyyy-MM").alias("month")).pivot(series, values).agg(F.avg((F.col("spread") > tol).cast("double")))


def sustained_switch_day(days: DataFrame, keys: list[str], share: str = "share", min_frac: float = 0.5, window: int = 7, min_days: int = 3) -> DataFrame:
    """First day from which the next ``window`` available days, at least ``min_days`` of them, all reach ``min_frac``."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(0, window - 1)
    d = days.withColumn("_min", F.min(share).over(w)).withColumn("_n", F.count("*").over(w))
    return d.groupBy(*keys).agg(F.min(F.when((F.col("_min") >= min_frac) & (F.col("_n") >= min_days), F.col("day"))).alias("switch_day"), F.min("day").alias("first_day"))


def resolution_transitions(df: DataFrame, series: list[str], resolutions: list[str], ts: str = "ts", resolution: str = "resolution") -> DataFrame:
    """Rows, first and last stamp of each resolution, and stamps present at several."""
    per = df.groupBy(*series, ts).agg(F.count_distinct(resolution).alias("_k"), *[F.sum((F.col(resolution) == r).cast("int")).alias(f"n_{r}") for r in resolutions])
    aggs = [F.sum((F.col("_k") > 1).cast("int")).alias("overlapping")]
    for r in resolutions:
        here = F.when(F.col(f"n_{r}") > 0, F.col(ts))
        aggs += [F.sum(f"n_{r}").alias(f"n_{r}"), F.min(here).alias(f"first_{r}"), F.max(here).alias(f"last_{r}")]
    return per.groupBy(*series).agg(*aggs)


def resolution_overlap(df: DataFrame, series: list[str], fine: str, coarse: str, tol: float = 1e-9) -> DataFrame:
    """Hours at both resolutions: how far their means differ."""
    h = df.groupBy(*series, grid.hour_of(F.col("ts")).alias("hour")).agg(*[F.avg(F.when(F.col("resolution") == r, F.col("value"))).alias(f"_{n}") for n, r in (("a", fine), ("b", coarse))])
    d = h.where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    return d.groupBy(*series).agg(F.count("*").alias("hours"), F.sum((F.col("_d") > tol).cast("int")).alias("differing"), F.max("_d").alias("max_diff"), F.median("_d").alias("median_diff"))


def series_health(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts, share of zeros and nulls, mean, maximum and the least step between sorted distinct values."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_distinct"), (100 * F.avg((F.abs(value) < 1e-9).cast("double"))).alias("pct_zero"), (100 * F.avg(F.col(value).isNull().cast("double"))).alias("pct_null"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    d = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    step = d.withColumn("_s", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value))).groupBy(*keys).agg(F.min("_s").alias("min_step"))
    return g.join(step, keys, "left")


def coverage(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """First and last stamp, hours spanned, observed and missing."""
    g = df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(ts).alias("observed"))
    g = g.withColumn("hours", F.timestamp_diff("HOUR", "first", "last") + 1)
    return g.withColumn("missing", F.col("hours") - F.col("observed")).withColumn("pct_observed", 100 * F.col("observed") / F.col("hours"))


def gap_runs(df: DataFrame, keys: list[str], ts: str = "ts", unit: str = "HOUR") -> DataFrame:
    """Runs of missing steps between stamps, straight from each stamp's successor: no grid."""
    d = carry.scan(df.select(*keys, F.col(ts).alias("_t")), keys, "_t", after={"_u": F.col("_t")})
    n = F.timestamp_diff(unit, F.col("_t"), F.col("_u")) - 1
    one = F.expr(f"interval 1 {unit.lower()}")
    return d.select(*keys, (F.col("_t") + one).alias("gap_start"), (F.col("_u") - one).alias("gap_end"), n.alias("hours")).where("hours > 0")


def gap_summary(gaps: DataFrame, keys: list[str]) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("hours").alias("missing"), F.max("hours").alias("longest"), F.median("hours").alias("median"))


def first_clean_date(df: DataFrame, keys: list[str], ts: str = "ts", max_gap: int = 3) -> DataFrame:
    """Earliest day after every series' first stamp and every gap longer than ``max_gap``; and the longest gap from there on."""
    gaps = gap_runs(df, keys, ts)
    first = df.groupBy(*keys).agg(F.min(ts).alias("_f")).agg(F.max(F.to_date("_f")).alias("first_day"))
    over = gaps.where(F.col("hours") > max_gap).agg(F.max(F.date_add(F.to_date("gap_end"), 1)).alias("after_gap"))
    c = F.broadcast(first.crossJoin(over).select(F.greatest("first_day", "after_gap").alias("clean_from")))
    rest = gaps.crossJoin(c).where(F.col("gap_start") >= F.col("clean_from").cast("timestamp_ntz"))
    return c.crossJoin(rest.agg(F.count("*").alias("later_gaps"), F.max("hours").alias("longest_later")))


def monthly_coverage(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    m = F.date_trunc("month", F.col(ts))
    g = df.groupBy(*keys, m.cast("timestamp_ntz").alias("month")).agg(F.count_distinct(ts).alias("observed"))
    return g.withColumn("share", F.col("observed") / (24 * F.dayofmonth(F.last_day("month"))))


def daily_presence(df: DataFrame, keys: list[str], ts: str = "ts", slots: int = 24) -> DataFrame:
    """Observed hours of each day between a key's first and last, days without any row included."""
    seen = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count_distinct(ts).alias("observed"))
    days = grid.complete_grid(seen, keys, "day", "1 day")
    return days.join(seen, [*keys, "day"], "left").withColumn("observed", F.coalesce("observed", F.lit(0))).withColumn("complete", F.col("observed") == slots)


def variance_report(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg(F.abs(value)).alias("mean_abs"), F.var_samp(value).alias("var"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_distinct(value).alias("n_unique"))
    return g.withColumns({"range": F.col("max") - F.col("min"), "relative_std": F.try_divide("std", "mean_abs"), "constant": F.col("max") == F.col("min"), "practically_zero": F.col("std") <= 0.001 * F.col("mean_abs")})


def hold_report(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", width: int = carry.WIDTH) -> DataFrame:
    """Runs of equal values: levels, runs, median and longest run. ``width``: seconds, or units of a number ``ts``, that a task takes at a time."""
    d = carry.scan(df.select(*keys, ts, F.col(value).alias("_v")), keys, ts, after={"_q": F.struct("_v")}, position="_n", width=width)
    last = d.where(F.col("_q").isNull() | ~F.col("_v").eqNullSafe(F.col("_q._v"))).select(*keys, ts, "_v", "_n")
    r = carry.scan(last, keys, ts, before={"_m": F.col("_n")}, width=width).withColumn("held", F.col("_n") - F.coalesce("_m", F.lit(0)))
    return r.groupBy(*keys).agg(F.count_distinct("_v").alias("levels"), F.count("*").alias("runs"), F.median("held").alias("median_held"), F.max("held").alias("max_held"))


def imputation_report(df: DataFrame, keys: list[str], methods: list[str], method: str = "method", observed: str = "observed", unfilled: str = "unfilled") -> DataFrame:
    """Of each key: hours, hours not observed and their share, hours by each method, hours left unfilled."""
    counts = [F.sum((F.col(method) == m).cast("int")).alias(m) for m in methods]
    g = df.groupBy(*keys).agg(F.count("*").alias("hours"), F.sum((F.col(method) != observed).cast("int")).alias("missing"), *counts, F.sum((F.col(method) == unfilled).cast("int")).alias("unfilled"))
    return g.withColumn("share", F.col("missing") / F.col("hours"))


def summary_join(keys: list[str], *reports: DataFrame) -> DataFrame:
    """Full outer join of reports on their keys."""
    out = reports[0]
    for r in reports[1:]:
        out = out.join(r, keys, "full_outer")
    return out


def compare_datasets(new: DataFrame, old: DataFrame, key: list[str], columns: list[str], tol: float) -> DataFrame:
    """For each column: rows only in one side, rows in both, changed rows and the largest difference."""
    a = new.select(*key, F.lit(1).alias("_a"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    b = old.select(*key, F.lit(1).alias("_b"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = a.join(b, key, "full_outer")
    long = j.select("_a", "_b", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("x"), F.col(f"_o_{c}").alias("y")) for c in columns])).alias("r")).select("_a", "_b", "r.*")
    d = F.abs(F.col("x") - F.col("y"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changed = both & ((d > tol) | (F.col("x").isNull() != F.col("y").isNull()))
    return long.groupBy("column").agg(F.sum(both.cast("int")).alias("overlap"), F.sum(F.col("_b").isNull().cast("int")).alias("only_new"), F.sum(F.col("_a").isNull().cast("int")).alias("only_old"), F.sum(F.coalesce(changed, F.lit(False)).cast("int")).alias("changed"), F.max(F.when(both, d)).alias("max_diff"))


def raw_inventory(df: DataFrame, keys: list[str], resolution: str = "resolution", ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(resolution)), ",").alias("resolutions"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in this order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
