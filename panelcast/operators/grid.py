"""Time-grid operators: collapse, completion, local days, as-of steps. Stamps are naive UTC unless named local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators import carry


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a naive stamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def collapse_to_hour(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", expected: Column | None = None) -> DataFrame:
    """Mean, number of slots, expected slots and whether slots are missing, for each key and hour.

    Resolutions coarser than an hour do not belong here; ``coarse_rows`` lists them.
    """
    expected = F.lit(1) if expected is None else expected
    g = df.groupBy(*keys, hour_of(F.col(ts)).alias("hour")).agg(F.avg(value).alias("value"), F.count(value).alias("slots"), F.max(expected).alias("expected_slots"))
    return g.withColumn("partial", F.col("slots") < F.col("expected_slots"))


def coarse_rows(df: DataFrame, keys: list[str], resolution: str = "resolution") -> DataFrame:
    """Keys that hold a resolution coarser than an hour, with the number of such rows."""
    fine = F.col(resolution).isin("PT15M", "PT30M", "PT60M", "PT1H")
    return df.where(~fine).groupBy(*keys, resolution).agg(F.count("*").alias("rows"))


def resolution_precedence(df: DataFrame, keys: list[str], order: list[str], resolution: str = "resolution") -> DataFrame:
    """One row a key: the resolution that comes first in ``order`` wins. A minimum, so it combines before the shuffle."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(resolution)), F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.when(rank == 0, 1000).otherwise(rank)).alias("_b"))
    return best.select(*keys, "_b.*")


def fold_if_constant(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tol: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """First value of each key and hour, and for each key the first hour whose values spread by more than ``tol`` (null: none)."""
    h = df.groupBy(*keys, hour_of(F.col(ts)).alias("hour")).agg(F.min_by(value, ts).alias("value"), (F.max(value) - F.min(value)).alias("spread"))
    first = h.groupBy(*keys).agg(F.min(F.when(F.col("spread") > tol, F.col("hour"))).alias("first_varying"))
    return h.select(*keys, "hour", "value"), first


def first_non_hourly(df: DataFrame, keys: list[str], ts: str = "ts", resolution: str = "resolution") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.when(F.col(resolution) != "PT60M", F.col(ts))).alias("first_non_hourly"))


def truncate_before_variation(df: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tol: float = 1e-9) -> DataFrame:
    """Hours before the day on which a key's values first vary within an hour."""
    folded, first = fold_if_constant(df, keys, ts, value, tol)
    j = folded.join(first, keys)
    return j.where(F.col("first_varying").isNull() | (F.col("hour") < F.to_date("first_varying").cast("timestamp_ntz"))).drop("first_varying")


def global_cutoff(df: DataFrame, zone: str, series: list[str], ts: str = "ts") -> DataFrame:
    """Last stamp of each zone (over its series the latest) and the earliest of these."""
    per = df.groupBy(zone, *series).agg(F.max(ts).alias("last")).groupBy(zone).agg(F.max("last").alias("last"))
    return per.crossJoin(F.broadcast(per.agg(F.min("last").alias("cutoff"))))


def complete_grid(df: DataFrame, keys: list[str], ts: str, step: str = "1 hour") -> DataFrame:
    """Every stamp between a key's first and last."""
    b = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return b.select(*keys, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(ts))


def missing_hours(df: DataFrame, keys: list[str], ts: str, step: str = "1 hour") -> DataFrame:
    return complete_grid(df, keys, ts, step).join(df.select(*keys, ts), [*keys, ts], "left_anti")


def on_grid(df: DataFrame, keys: list[str], ts: str, step: str = "1 hour") -> DataFrame:
    """The panel on its complete grid, gaps null."""
    return complete_grid(df, keys, ts, step).join(df, [*keys, ts], "left")


def to_local(ts: Column, tz: str | Column) -> Column:
    """Naive local stamp of a naive UTC stamp."""
    return F.from_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")


def to_utc(ts: Column, tz: str | Column) -> Column:
    return F.to_utc_timestamp(ts.cast("timestamp"), tz).cast("timestamp_ntz")


def to_local_grid(df: DataFrame, keys: list[str], tz: str | Column, ts: str = "ts", value: str = "value") -> DataFrame:
    """Hours by local stamp: the repeated autumn hour averaged, the grid completed, gaps null.

    Here and below ``tz`` is one time zone, or a column of the keys, as each zone of a
    panel may have its own.
    """
    loc = df.groupBy(*keys, to_local(F.col(ts), tz).alias("local")).agg(F.avg(value).alias(value), F.count("*").alias("n_utc"))
    return on_grid(loc, keys, "local")


def is_skipped(local: Column, tz: str | Column) -> Column:
    """Local stamps that the clock jumps over in spring."""
    return to_local(to_utc(local, tz), tz) != local


def fill_skipped_hours(df: DataFrame, keys: list[str], tz: str | Column, local: str = "local", value: str = "value") -> DataFrame:
    """The skipped hour becomes the mean of its neighbours, if both are there; other gaps stay."""
    near = F.struct(F.col(value).alias("v"))
    d = carry.scan(df, keys, local, before={"_l": near}, after={"_r": near})
    mean = (F.col("_l.v") + F.col("_r.v")) / 2
    adj = F.col(value).isNull() & is_skipped(F.col(local), tz)
    return d.withColumn("_m", F.when(adj, mean)).withColumn("dst_adjustment", F.when(F.col("_m").isNotNull(), "spring_interpolation").when(F.coalesce("n_utc", F.lit(1)) > 1, "autumn_average").otherwise("none")).withColumn(value, F.coalesce(value, "_m")).drop("_m", "_l", "_r")


def interpolate_gaps(df: DataFrame, keys: list[str], ts: str, value: str = "value", max_gap: int = 3) -> DataFrame:
    """Linear over inner gaps of at most ``max_gap`` steps of a gridded panel; ``violation`` marks nulls left (long or edge gaps)."""
    d = carry.scan(df, keys, ts, back={"_p": F.col(value)}, ahead={"_q": F.col(value)}, position="_n")
    gap = F.col("_q_at") - F.col("_p_at") - 1
    lin = F.col("_p") + (F.col("_q") - F.col("_p")) * (F.col("_n") - F.col("_p_at")) / F.nullif(F.col("_q_at") - F.col("_p_at"), F.lit(0))
    out = F.coalesce(F.col(value), F.when(gap <= max_gap, lin))
    return d.withColumn(value, out).withColumn("violation", F.col(value).isNull()).drop("_n", "_p", "_p_at", "_q", "_q_at")


def day_matrix(df: DataFrame, keys: list[str], ts: str, value: str = "value", slots: int = 24) -> DataFrame:
    """One row for each key and day with an array of ``slots`` values, null where an hour is missing."""
    g = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.map_from_entries(F.collect_list(F.struct(F.hour(ts).alias("h"), F.col(value).alias("v")))).alias("_m"))
    return g.select(*keys, "day", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda h: F.try_element_at("_m", h)).alias("slots"))


def dst_report(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Of each key's local days those with 23 and with 25 hours (spring, autumn), and whether they equal those of all other keys.

    ``ts`` is a naive local stamp in which the repeated hour stands twice.
    """
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.count_distinct(ts).alias("k"))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("day"))))
    g = days.groupBy(*keys).agg(pick((F.col("n") == 23) & (F.col("k") == 23)).alias("spring"), pick((F.col("n") == 25) & (F.col("k") == 24)).alias("autumn"))
    both = g.agg(F.count_distinct(F.to_json(F.struct("spring", "autumn"))).alias("_k"))
    return g.crossJoin(both).withColumn("equal", F.col("_k") == 1).drop("_k")


def flatten_day_matrix(df: DataFrame, keys: list[str], slots: str = "slots") -> DataFrame:
    d = df.select(*keys, "day", F.posexplode(slots).alias("slot", "value"))
    return d.select(*keys, (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("slot"))).alias("ts"), "value")


def step_hold(grid: DataFrame, levels: DataFrame, keys: list[str], ts: str, level_ts: str, level: str, delay: str) -> DataFrame:
    """As-of: a level shows on the grid from ``delay`` after its stamp until the next one; nothing before the first."""
    ev = levels.select(*keys, (F.col(level_ts) + F.expr(f"interval {delay}")).alias(ts), F.col(level).alias("_l"), F.lit(0).alias("_g"))
    u = grid.select(*keys, ts).withColumns({"_l": F.lit(None).cast("double"), "_g": F.lit(1)}).unionByName(ev)
    return carry.scan(u, keys, ts, back={"level": F.col("_l")}, order=("_g",)).where("_g = 1").select(*keys, ts, "level")


def leading_nulls(held: DataFrame, keys: list[str], ts: str, level: str = "level") -> DataFrame:
    """Keys whose grid starts before their first level: how many stamps lack one."""
    return held.where(F.col(level).isNull()).groupBy(*keys).agg(F.count("*").alias("stamps"), F.max(ts).alias("last"))


def snap_weekly(ts: Column, tz: str) -> Column:
    """UTC stamp of the nearest local midnight."""
    return to_utc(F.date_trunc("day", to_local(ts, tz) + F.expr("interval 12 hours")).cast("timestamp_ntz"), tz)


def snap_levels(df: DataFrame, keys: list[str], tz: str, ts: str = "ts", value: str = "value", seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Weekly levels at the nearest local midnight, the first of each by ``seq`` (or value); and stamps that snap to another day than Monday."""
    s = df.withColumn("_s", snap_weekly(F.col(ts), tz))
    one = s.groupBy(*keys, F.col("_s").alias("snapped")).agg(F.min_by(value, F.struct(seq or value, value)).alias(value))
    return one, s.where(F.weekday(to_local(F.col("_s"), tz)) != 0).select(*keys, ts, F.col("_s").alias("snapped"))


def dst_calendar(spark, first: int, last: int) -> DataFrame:
    """EU clock changes: the last Sundays of March and October."""
    y = spark.range(first, last + 1).withColumnRenamed("id", "year")

    def sunday(m: int) -> Column:
        return F.next_day(F.date_sub(F.last_day(F.make_date(F.col("year").cast("int"), F.lit(m), F.lit(1))), 7), "Sun")

    return y.select(F.col("year").cast("int").alias("year"), sunday(3).alias("spring"), sunday(10).alias("autumn"))


def local_day_normalize(df: DataFrame, keys: list[str], tz: str | Column, flags: list[str], firsts: dict[str, str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Strict local days: the skipped hour the mean of its neighbours, the repeated one averaged; ``violation`` marks any other missing hour.

    ``flags`` are true if true in any hour merged; ``firsts`` keep the first value that
    differs from their default.
    """
    aggs = [F.bool_or(c).alias(c) for c in flags] + [F.min_by(F.when(F.col(c) != d, F.col(c)), F.when(F.col(c) != d, F.col(ts))).alias(c) for c, d in firsts.items()]
    loc = df.groupBy(*keys, to_local(F.col(ts), tz).alias("local")).agg(F.avg(value).alias(value), F.count("*").alias("n_utc"), *aggs)
    d = fill_skipped_hours(on_grid(loc, keys, "local"), keys, tz, "local", value)
    d = d.withColumns({**{c: F.coalesce(c, F.lit(False)) for c in flags}, **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in firsts.items()}})
    return d.withColumn("violation", F.col(value).isNull()).drop("n_utc")


def coverage_vs_grid(df: DataFrame, keys: list[str], tz: str | Column, ts: str = "ts", max_gap: int = 3) -> DataFrame:
    """Hours of the local grid, those missing (without hours that do not exist) and runs longer than ``max_gap``."""
    g = on_grid(df.groupBy(*keys, to_local(F.col(ts), tz).alias("local")).agg(F.lit(1).alias("_there")), keys, "local").where(~is_skipped(F.col("local"), tz))
    g = carry.scan(g, keys, "local", total={"_run": F.col("_there")})
    runs = g.where("_there IS NULL").groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    s = runs.groupBy(*keys).agg(F.sum("_n").alias("missing"), F.sum((F.col("_n") > max_gap).cast("int")).alias("oversized"))
    return g.groupBy(*keys).agg(F.count("*").alias("hours")).join(s, keys, "left").na.fill(0, ["missing", "oversized"])
