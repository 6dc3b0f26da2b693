"""The given tables as panels: DataFrames and the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.operators import grid


ZONES = ["click", "error", "purchase", "signup", "view"]
KEY5 = ["zone", "variable", "psr_type", "resolution", "ts"]
CPH = "timezone('Europe/Copenhagen', timezone('UTC', {}))"
#: The events' hours moved to a span with a clock change in spring.
YEAR = "year AS (SELECT series, ts + INTERVAL 85 DAY AS ts, value FROM hourly)"


def rounded(x: Column | str, digits: int) -> Column:
    """``x`` times a power of ten, rounded to an integer and divided again, as SQL engines round binary numbers.

    Spark's own ``round`` looks at the shortest decimal of a number: a mean that lies one
    bit below a tie then goes another way.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), 6) for c in cols})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw observations of mixed resolution."""
    e = table(spark, sf_dir, "events")
    fine = F.col("event_id") % 5 < 4
    hour = grid.hour_of(F.col("ts"))
    quarter = hour + F.make_dt_interval(mins=(F.floor(F.minute("ts") / 15) * 15).cast("int"))
    return e.select(
        F.col("event_type").alias("zone"),
        F.when(F.col("user_id") % 2 == 0, "load").otherwise("price").alias("variable"),
        F.when(F.col("user_id") % 3 == 0, "B16").when(F.col("user_id") % 3 == 1, "B18").alias("psr_type"),
        F.when(fine, "PT15M").otherwise("PT60M").alias("resolution"),
        F.when(fine, quarter).otherwise(hour).alias("ts"),
        "value",
        F.col("event_id").alias("ingest_seq"),
    )


RAW = """raw AS (SELECT event_type AS zone, CASE WHEN user_id % 2 = 0 THEN 'load' ELSE 'price' END AS variable,
  CASE user_id % 3 WHEN 0 THEN 'B16' WHEN 1 THEN 'B18' END AS psr_type,
  CASE WHEN event_id % 5 < 4 THEN 'PT15M' ELSE 'PT60M' END AS resolution,
  CASE WHEN event_id % 5 < 4 THEN time_bucket(INTERVAL 15 MINUTE, ts) ELSE date_trunc('hour', ts) END AS ts, value, event_id AS ingest_seq FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each event type and hour: (series, ts, value); hours without events are absent."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), grid.hour_of(F.col("ts")).alias("ts")).agg(F.avg("value").alias("value"))


HOURLY = "hourly AS (SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)"


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly on its complete grid, gaps null."""
    return grid.on_grid(hourly(spark, sf_dir), ["series"], "ts")


GRIDDED = (
    HOURLY
    + """, grid AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY series),
gridded AS (SELECT g.series, g.ts, h.value FROM grid g LEFT JOIN hourly h ON h.series = g.series AND h.ts = g.ts)"""
)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by priority and day: (series, ts, value)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("o_totalprice").alias("value"))


DAILY = "daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS TIMESTAMP) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line item prices by flag and status and day: (series, ts, value)."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("l_extendedprice").alias("value"))


LINES = "lines AS (SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS TIMESTAMP) AS ts, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"


def spring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("interval 85 days"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an hourly panel of two zones over all their days, gaps held: (zone, ts, price, load, wind)."""
    o = table(spark, sf_dir, "orders")
    zone = F.when(F.col("o_orderpriority") < "3", "A").otherwise("B")
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    h = o.groupBy(zone.alias("zone"), ts.alias("ts")).agg(F.sum("o_totalprice").alias("price"), F.count("*").cast("double").alias("load"), F.avg("o_custkey").alias("wind"))
    b = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("timestamp_ntz").alias("a"), (F.max("o_orderdate").cast("timestamp_ntz") + F.expr("interval 23 hours")).alias("b"))
    g = h.select("zone").distinct().crossJoin(b).select("zone", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts")).join(h, ["zone", "ts"], "left")
    w = Window.partitionBy("zone").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumns({c: F.coalesce(F.last(c, True).over(w), F.lit(0.0)) for c in ("price", "load", "wind")})


WIDE = """ho AS (SELECT CASE WHEN o_orderpriority < '3' THEN 'A' ELSE 'B' END AS zone, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS ts,
  sum(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS load, avg(o_custkey) AS wind FROM orders GROUP BY ALL),
bo AS (SELECT CAST(min(o_orderdate) AS TIMESTAMP) AS a, CAST(max(o_orderdate) AS TIMESTAMP) + INTERVAL 23 HOUR AS b FROM orders),
go AS (SELECT zone, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT zone FROM ho), bo),
wide AS (SELECT zone, ts, coalesce(last_value(price IGNORE NULLS) OVER w, 0) AS price, coalesce(last_value(load IGNORE NULLS) OVER w, 0) AS load, coalesce(last_value(wind IGNORE NULLS) OVER w, 0) AS wind
  FROM go LEFT JOIN ho USING (zone, ts) WINDOW w AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
WARR = WIDE + ", warr AS (SELECT zone, CAST(ts AS DATE) AS day, list(price ORDER BY ts) AS price, list(load ORDER BY ts) AS load, list(wind ORDER BY ts) AS wind FROM wide GROUP BY ALL)"

#: Upper tail of the standard normal at x >= 0 by its power series, as SQL has no error function.
PHI = "CASE WHEN {x} > 8 THEN 0 ELSE 0.5 - exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: CASE WHEN {x} = 0 THEN 0 ELSE exp((2 * k + 1) * ln({x}) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) END)) END"


def sf(x: str) -> str:
    """SQL of the upper tail of the standard normal at ``x``."""
    return f"CASE WHEN {x} >= 0 THEN {PHI.format(x=f'abs({x})')} ELSE 1 - ({PHI.format(x=f'abs({x})')}) END"
