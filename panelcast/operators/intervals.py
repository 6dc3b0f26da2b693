"""Joins of stamps with intervals, and of intervals with intervals, by bins.

Intervals of mixed lengths stand in one table of bins whose width fits each of them: an
interval belongs to the level of the least power of two at or above its length. A stamp
is in one bin of each level that occurs, so both sides meet in an equi-join on (keys,
level, bin), and the bounds are checked there. Neither side is compared with all of the
other, and a long interval's stamps are spread over several bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of an interval that stamps look for, as a power of two.
FINE = 4


def _micros(df: DataFrame, col: str) -> Column:
    """A stamp, date or number as a number."""
    kind = df.schema[col].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz"))
    return F.col(col).cast("double")


def _level(length: Column) -> Column:
    """The least power of two at or above a length, as an exponent; lengths up to 1 are one level."""
    return F.ceil(F.log2(F.greatest(length.cast("double"), F.lit(1.0)))).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def _with_levels(df: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their keys' levels; without keys there is one row of levels."""
    if keys:
        return df.join(levels, keys)
    zero = F.pmod(F.xxhash64(df.columns[0]), F.lit(1))  # a key that is not folded away, so this is a hash join with one row
    return df.withColumn("_one", zero).join(F.broadcast(levels.withColumn("_one", F.pmod(F.xxhash64("_levels"), F.lit(1)))), "_one").drop("_one")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """Every row of ``points`` with every row of ``spans`` of equal ``keys`` that holds its stamp: start <= ts < end.

    Columns of both; names other than the keys must differ. Rows with null stamps or
    bounds, and empty or reversed intervals, meet nothing. ``keys`` may be empty.
    """
    a, b = _micros(spans, start), _micros(spans, end)
    s = spans.where(F.col(start) < F.col(end)).withColumn("_level", _level(b - a))
    # the levels that occur, by key: a few rows each
    levels = s.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    first, last = _bin(a, F.col("_level") - FINE), _bin(b, F.col("_level") - FINE)
    s = s.withColumn("_bin", F.explode(F.sequence(first, last)))
    p = _with_levels(points.where(F.col(ts).isNotNull()), levels, keys)
    p = p.withColumn("_level", F.explode("_levels")).withColumn("_bin", _bin(_micros(points, ts), F.col("_level") - FINE)).drop("_levels")
    return p.join(s, [*keys, "_level", "_bin"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_level", "_bin")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bounds_a: tuple[str, str], bounds_b: tuple[str, str]) -> DataFrame:
    """Every pair of intervals of equal ``keys`` that overlap, once: start_a < end_b and start_b < end_a.

    Columns of both; names other than the keys must differ. Nulls, empty and reversed
    intervals meet nothing. Each interval goes to the bins of its own level and of every
    longer level that occurs on the other side; a pair meets at the level of the longer
    of the two and is kept in the first bin that both reach.
    """
    sides = []
    for df, (start, end) in ((a, bounds_a), (b, bounds_b)):
        x, y = _micros(df, start), _micros(df, end)
        sides.append(df.where(F.col(start) < F.col(end)).withColumns({f"_x_{len(sides)}": x, f"_y_{len(sides)}": y, f"_own_{len(sides)}": _level(y - x)}))
    one, two = sides
    levels = [s.groupBy(*keys).agg(F.collect_set(f"_own_{i}").alias("_levels")) for i, s in enumerate(sides)]

    def placed(df: DataFrame, i: int) -> DataFrame:
        df, own = _with_levels(df, levels[1 - i], keys), F.col(f"_own_{i}")
        at = F.array_distinct(F.concat(F.array(own), F.filter("_levels", lambda v: v > own)))
        df = df.withColumn("_level", F.explode(at)).drop("_levels")
        return df.withColumn("_bin", F.explode(F.sequence(_bin(F.col(f"_x_{i}"), F.col("_level")), _bin(F.col(f"_y_{i}"), F.col("_level")))))

    met = placed(one, 0).join(placed(two, 1), [*keys, "_level", "_bin"]).where((F.col("_x_0") < F.col("_y_1")) & (F.col("_x_1") < F.col("_y_0")))
    first = F.col("_bin") == _bin(F.greatest("_x_0", "_x_1"), F.col("_level"))
    longer = F.col("_level") == F.greatest("_own_0", "_own_1")
    return met.where(first & longer).drop("_level", "_bin", *[f"_{n}_{i}" for n in ("x", "y", "own") for i in (0, 1)])
