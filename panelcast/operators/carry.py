"""Running values of series that are split by time: a prefix scan in two levels.

A window over a series puts all its rows into one task. Here a series is cut into
buckets of time. Each bucket is reduced to what it hands on (last and first values, sums,
number of rows), these few rows are scanned by series, and every bucket gets two rows of
its own, one before its first row with what comes from earlier buckets and one after its
last with what comes from later ones. Windows then span a bucket only, so one series is
spread over as many tasks as it has buckets. Null keys are keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a bucket: 28 days.
WIDTH = 28 * 86400


def bucket_of(df: DataFrame, ts: str, width: int = WIDTH) -> Column:
    """Number of the bucket of a stamp, date or (in units of its own) number; null for null."""
    if isinstance(df.schema[ts].dataType, T.NumericType):
        return F.floor(F.col(ts) / width)
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    return F.floor(seconds / width)


def scan(
    df: DataFrame,
    keys: list[str],
    ts: str,
    *,
    back: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    ahead: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    position: str | None = None,
    order: tuple[str, ...] = (),
    width: int = WIDTH,
) -> DataFrame:
    """``df`` with running values of each series, in the order of ``ts`` and then ``order``.

    back, before: the last value that is not null of an expression, up to the row or
    before it; ahead, after: the first one from the row or after it; total: the sum up to
    the row. With ``position``, a column of that name numbers a series' rows from 1, and
    each back, before, ahead or after column ``c`` comes with ``c_at``, the number of the
    row its value is from. A value that may itself be null is wrapped into a struct.
    """
    back, before, ahead, after, total = ({} if x is None else x for x in (back, before, ahead, after, total))
    down, up = {**back, **before}, {**ahead, **after}
    names = [*down, *up, *total]
    src = {n: f"_x_{n}" for n in names}
    b, by = "_bucket", [ts, *order]
    rows = df.withColumns({b: bucket_of(df, ts, width), **{src[n]: {**down, **up, **total}[n] for n in names}})
    cell = Window.partitionBy(*keys, b).orderBy(*by)
    # what each bucket hands on
    own = rows.withColumn("_n", F.row_number().over(cell)) if position else rows
    at = F.col("_n") if position else F.struct(*by)
    when = {n: F.when(F.col(src[n]).isNotNull(), at) for n in names}
    aggs = [F.count("*").alias("_rows")]
    aggs += [F.max_by(src[n], when[n]).alias(f"_v_{n}") for n in down] + [F.min_by(src[n], when[n]).alias(f"_v_{n}") for n in up] + [F.sum(src[n]).alias(f"_v_{n}") for n in total]
    if position:
        aggs += [F.max(when[n]).alias(f"_p_{n}") for n in down] + [F.min(when[n]).alias(f"_p_{n}") for n in up]
    parts = own.groupBy(*keys, b).agg(*aggs)
    # scanned by series: one row a bucket
    along = Window.partitionBy(*keys).orderBy(b)
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    far = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(F.col(f"_v_{n}").alias("v"), (F.col("_off") + F.col(f"_p_{n}") if position else F.lit(0).cast("long")).alias("p")))
    parts = parts.withColumns({f"_f_{n}": far(n) for n in [*down, *up]})
    first = parts.select(*keys, b, F.lit(0).alias("_side"), "_off", *[F.last(f"_f_{n}", True).over(earlier).alias(f"_f_{n}") for n in down], *[F.sum(f"_v_{n}").over(earlier).alias(f"_f_{n}") for n in total])
    end = parts.select(*keys, b, F.lit(2).alias("_side"), *[F.first(f"_f_{n}", True).over(later).alias(f"_f_{n}") for n in up])
    # within a bucket, between its two rows
    both = rows.withColumn("_side", F.lit(1)).unionByName(first, allowMissingColumns=True)
    if up:
        both = both.unionByName(end, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, b).orderBy("_side", *by)
    if position:
        both = both.withColumn(position, F.row_number().over(inside) - 1 + F.first("_off").over(inside))
    here = lambda n: F.when((F.col("_side") == 1) & F.col(src[n]).isNotNull(), F.struct(F.col(src[n]).alias("v"), (F.col(position).cast("long") if position else F.lit(0).cast("long")).alias("p")))
    both = both.withColumns({f"_f_{n}": F.coalesce(here(n), F.col(f"_f_{n}")) for n in [*down, *up]})
    both = both.withColumns({f"_f_{n}": F.coalesce(F.col(src[n]), F.col(f"_f_{n}")) for n in total})
    span = {n: inside.rowsBetween(Window.unboundedPreceding, 0 if n in back else -1) for n in down} | {n: inside.rowsBetween(0 if n in ahead else 1, Window.unboundedFollowing) for n in up}
    got = {n: F.last(f"_f_{n}", True).over(span[n]) for n in down} | {n: F.first(f"_f_{n}", True).over(span[n]) for n in up}
    got |= {n: F.sum(f"_f_{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n in total}
    out = both.withColumns({f"_o_{n}": c for n, c in got.items()}).where("_side = 1")
    cols = [F.col(c) for c in df.columns if c not in {*names, position}]
    for n in names:
        cols.append(F.col(f"_o_{n}").alias(n) if n in total else F.col(f"_o_{n}.v").alias(n))
        if position and n not in total:
            cols.append(F.col(f"_o_{n}.p").alias(f"{n}_at"))
    return out.select(*cols, *([F.col(position).cast("long").alias(position)] if position else []))
