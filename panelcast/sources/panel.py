"""Readers, writers and maintenance of raw panels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import grid, intervals

#: Columns of a raw panel; key: zone, variable, psr_type, resolution, timestamp_utc.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("zone", "eic", "variable", "document_type", "process_type")]
    + [T.StructField("timestamp_utc", T.TimestampNTZType()), T.StructField("value", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("resolution", "psr_type", "business_type", "curve_type", "contract_type", "unit", "currency")]
)
KEY = ["zone", "variable", "psr_type", "resolution", "timestamp_utc"]
#: Bidding zones and countries: code, area code, time zone, name.
ZONES = [
    ("DK1", "10YDK-1--------W", "Europe/Copenhagen", "Denmark West"),
    ("DK2", "10YDK-2--------M", "Europe/Copenhagen", "Denmark East"),
    ("FI", "10YFI-1--------U", "Europe/Helsinki", "Finland"),
    ("NO1", "10YNO-1--------2", "Europe/Oslo", "Norway 1 (Oslo)"),
    ("NO2", "10YNO-2--------T", "Europe/Oslo", "Norway 2 (Kristiansand)"),
    ("NO3", "10YNO-3--------J", "Europe/Oslo", "Norway 3 (Trondheim)"),
    ("NO4", "10YNO-4--------9", "Europe/Oslo", "Norway 4 (Tromso)"),
    ("NO5", "10Y1001A1001A48H", "Europe/Oslo", "Norway 5 (Bergen)"),
    ("SE1", "10Y1001A1001A44P", "Europe/Stockholm", "Sweden 1 (Lulea)"),
    ("SE2", "10Y1001A1001A45N", "Europe/Stockholm", "Sweden 2 (Sundsvall)"),
    ("SE3", "10Y1001A1001A46L", "Europe/Stockholm", "Sweden 3 (Stockholm)"),
    ("SE4", "10Y1001A1001A47J", "Europe/Stockholm", "Sweden 4 (Malmo)"),
    ("SE", "10YSE-1--------K", "Europe/Stockholm", "Sweden"),
    ("BE", "10YBE----------2", "Europe/Brussels", "Belgium"),
    ("DE_LU", "10Y1001A1001A82H", "Europe/Berlin", "Germany-Luxembourg"),
    ("DE", "10Y1001A1001A83F", "Europe/Berlin", "Germany"),
    ("FR", "10YFR-RTE------C", "Europe/Paris", "France"),
    ("NL", "10YNL----------L", "Europe/Amsterdam", "Netherlands"),
    ("AT", "10YAT-APG------L", "Europe/Vienna", "Austria"),
    ("CH", "10YCH-SWISSGRIDZ", "Europe/Zurich", "Switzerland"),
    ("ES", "10YES-REE------0", "Europe/Madrid", "Spain"),
    ("PT", "10YPT-REN------W", "Europe/Lisbon", "Portugal"),
    ("IT_NORD", "10Y1001A1001A73I", "Europe/Rome", "Italy North"),
    ("PL", "10YPL-AREA-----S", "Europe/Warsaw", "Poland"),
    ("CZ", "10YCZ-CEPS-----N", "Europe/Prague", "Czech Republic"),
]


def zone_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone string, eic string, tz string, name string")


def with_zone(df: DataFrame, dim: DataFrame, zone: str = "zone") -> DataFrame:
    """Join the dimension; an unknown code (case does not matter) is an error when its row is computed."""
    known = dim.withColumn("_known", F.lit(True)).withColumnRenamed(zone, "_code")
    j = df.join(known, F.upper(zone) == F.col("_code"), "left").drop("_code")
    error = F.raise_error(F.concat(F.lit("unknown zone "), F.coalesce(zone, F.lit("null")))).cast("boolean")
    return j.where(F.when(F.col("_known").isNotNull(), F.lit(True)).otherwise(error)).drop("_known")


def read_raw_panel(spark: SparkSession, path: str, zones: list[str] | None = None, exclude: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Raw panel with predicates that reach the scan; ``end`` covers its whole last hour."""
    df = spark.read.schema(RAW_SCHEMA).parquet(path)
    if zones:
        df = df.where(F.col("zone").isin(*zones))
    if exclude:
        df = df.where(~F.col("variable").isin(*exclude))
    if start:
        df = df.where(F.col("timestamp_utc") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("timestamp_utc") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 hour"))
    return df


def write_raw(df: DataFrame, path: str) -> None:
    """One dataset partitioned by zone and variable."""
    df.write.partitionBy("zone", "variable").parquet(path)


def read_wide_csv(spark: SparkSession, path: str, exogenous: int) -> DataFrame:
    """Hourly CSV: stamp, price and exogenous columns, named by position."""
    names = ["ts", "price", *[f"exogenous_{i + 1}" for i in range(exogenous)]]
    schema = "ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names[1:])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def export_wide_csv(df: DataFrame, path: str) -> None:
    """One folder for each zone, ISO 8601 stamps."""
    df.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").partitionBy("zone").csv(path, header=True)


def write_clean_panel(df: DataFrame, path: str, keys: list[str], ts: str = "ts") -> None:
    """One dataset partitioned by ``keys``, each part sorted by stamp."""
    df.repartition(*keys).sortWithinPartitions(*keys, ts).write.partitionBy(*keys).parquet(path)


def report_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def train_test_split(df: DataFrame, years: int = 2, ts: str = "ts", begin: str | None = None, end: str | None = None) -> DataFrame:
    """Marks the last ``364 * years`` days as test; with ``begin`` and ``end`` the days from one to the other, and what follows (null) as neither."""
    if begin:
        day, a, b = F.to_date(ts), F.lit(begin).cast("date"), F.lit(end).cast("date")
        return df.withColumn("is_test", F.when(day < a, F.lit(False)).when(day <= b, F.lit(True)))
    b = F.broadcast(df.agg(F.max(F.to_date(ts)).alias("_end")))  # one row
    return df.crossJoin(b).withColumn("is_test", F.to_date(ts) > F.date_sub("_end", 364 * years)).drop("_end")


def read_market_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, rejections) of a folder of market documents.

    points: (series, start, end, resolution, position, value, psr_type, business_type,
    curve_type, unit, currency). rejections: reasons other than 999, which only says
    that there is no data.
    """
    t = "string"
    point = "array<struct<position:int,`price.amount`:double,quantity:double>>"
    period = f"array<struct<timeInterval:struct<start:{t},end:{t}>,resolution:{t},Point:{point}>>"
    schema = f"mRID {t}, businessType {t}, curveType {t}, `currency_Unit.name` {t}, `price_Measure_Unit.name` {t}, `quantity_Measure_Unit.name` {t}, MktPSRType struct<psrType:{t}>, Period {period}"
    s = spark.read.format("xml").option("rowTag", "TimeSeries").schema(schema).load(path)
    p = s.select("*", F.explode("Period").alias("p")).select("*", F.explode("p.Point").alias("pt"))
    stamp = lambda c: F.to_timestamp(c, "yyyy-MM-dd'T'HH:mmX").cast("timestamp_ntz")
    points = p.select(
        F.col("mRID").alias("series"),
        stamp(F.col("p.timeInterval.start")).alias("start"),
        stamp(F.col("p.timeInterval.end")).alias("end"),
        F.col("p.resolution").alias("resolution"),
        F.col("pt.position").alias("position"),
        F.coalesce(F.col("pt.`price.amount`"), F.col("pt.quantity")).alias("value"),
        F.col("MktPSRType.psrType").alias("psr_type"),
        F.col("businessType").alias("business_type"),
        F.col("curveType").alias("curve_type"),
        F.coalesce("`price_Measure_Unit.name`", "`quantity_Measure_Unit.name`").alias("unit"),
        F.col("`currency_Unit.name`").alias("currency"),
    )
    reasons = spark.read.format("xml").option("rowTag", "Reason").schema("code string, text string").load(path)
    return points, reasons.where("code <> '999'")


def write_market_xml(points: DataFrame, path: str, reasons: DataFrame | None = None) -> None:
    """Market documents that ``read_market_xml`` reads: one time series for each (series, period), and rejections (code, text).

    ``points`` has series, start, end, resolution, position, value and may have psr_type,
    business_type, curve_type, unit and currency; what is null is left out.
    """
    have = lambda c: F.col(c) if c in points.columns else F.lit(None).cast("string")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")
    per = ["series", "start", "end", "resolution", *[c for c in ("psr_type", "business_type", "curve_type", "unit", "currency") if c in points.columns]]
    g = points.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("position", F.col("value").alias("quantity")))).alias("_points"))
    interval = F.struct(text("start").alias("start"), text("end").alias("end"))
    doc = g.select(
        F.col("series").cast("string").alias("mRID"),
        have("business_type").alias("businessType"),
        have("curve_type").alias("curveType"),
        have("currency").alias("currency_Unit.name"),
        have("unit").alias("quantity_Measure_Unit.name"),
        F.when(have("psr_type").isNotNull(), F.struct(have("psr_type").alias("psrType"))).alias("MktPSRType"),
        F.array(F.struct(interval.alias("timeInterval"), "resolution", F.col("_points").alias("Point"))).alias("Period"),
    )
    doc.write.format("xml").option("rootTag", "GL_MarketDocument").option("rowTag", "TimeSeries").mode("append").save(path)
    if reasons is not None:
        reasons.select("code", "text").write.format("xml").option("rootTag", "Acknowledgement_MarketDocument").option("rowTag", "Reason").mode("append").save(path)


def step_minutes(resolution: Column) -> Column:
    """Minutes of an ISO resolution of the platform."""
    return F.when(resolution == "PT15M", 15).when(resolution == "PT30M", 30).when(resolution.isin("PT60M", "PT1H"), 60).when(resolution == "P1D", 1440).when(resolution == "P7D", 10080)


def expand_sparse_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Every slot of each period, the last value carried on; slots before the first value are absent.

    ``points`` has keys, start, end, resolution, position, value. A position beyond
    the period's slots is an error.
    """
    step = step_minutes(F.col("resolution"))
    n = F.round(F.timestamp_diff("MINUTE", "start", "end") / step).cast("int")
    per = [*keys, "start", "end", "resolution"]
    g = points.groupBy(*per).agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("_m"), F.max("position").alias("_top"))
    g = g.withColumn("_n", n).withColumn("_n", F.when(F.col("_top") <= F.col("_n"), F.col("_n")).otherwise(F.raise_error(F.lit("position beyond the period")).cast("int")))
    s = g.select(*per, "_m", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("slot"))
    s = s.withColumn("_v", F.try_element_at("_m", F.col("slot")))
    w = Window.partitionBy(*per).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    ts = F.col("start") + F.make_dt_interval(mins=((F.col("slot") - 1) * step).cast("int"))
    return s.withColumn("value", F.last("_v", True).over(w)).where("value IS NOT NULL").select(*per, "slot", ts.alias("ts"), "value")


def collapse_publications(df: DataFrame, keys: list[str], seq: str, how: str = "first", psr: str = "psr_type", value: str = "value") -> DataFrame:
    """Overlapping publications: the first of each key, or the first of each key and type, summed over types."""
    k = keys if how == "first" else [*keys, psr]
    one = df.groupBy(*k).agg(F.min_by(value, seq).alias(value))
    return one if how == "first" else one.groupBy(*keys).agg(F.sum(value).alias(value))


def shape_raw(df: DataFrame, zone: Column, variable: str) -> DataFrame:
    """Points to the raw schema; what they lack is null. The unit is the price's measure where there is one, else the quantity's."""
    have = {"zone": zone, "variable": F.lit(variable), "timestamp_utc": F.col("ts")}
    units = [c for c in ("price_unit", "quantity_unit") if c in df.columns]
    if units:
        have["unit"] = F.coalesce(*units)
    cols = [(have[f.name] if f.name in have else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA]
    return df.select(*cols)


def coverage_manifest(df: DataFrame, expected: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, first and last stamp, resolutions and types of each expected (zone, variable), empty ones too."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    g = df.groupBy("zone", "variable").agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"), join("resolution").alias("resolutions"), join("psr_type").alias("psr_types"))
    return expected.join(g, ["zone", "variable"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def missing_items(expected: DataFrame, present: DataFrame, answered: DataFrame) -> DataFrame:
    """Expected (zone, variable) neither present nor answered without an error."""
    k = ["zone", "variable"]
    return expected.select(*k).join(present.select(*k).distinct(), k, "left_anti").join(answered.where("error IS NULL").select(*k).distinct(), k, "left_anti")


def merge_requery(existing: DataFrame, fetched: DataFrame, key: list[str], value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, additions, conflicts): only rows of new keys are added; nulls in keys and values equal each other. Two values for a fetched key are an error; of rows equal in key and value one counts."""
    rest = [c for c in fetched.columns if c not in (*key, value)]
    f = fetched.groupBy(*key, value).agg(*[F.min(c).alias(c) for c in rest]).select(fetched.columns) if rest else fetched.distinct()
    twice = f.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"fetched key {tuple(twice[0][k] for k in key)} has several rows")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    cond = F.lit(True)
    for c in same("f", "e"):
        cond = cond & c
    add = f.alias("f").join(existing.alias("e"), cond, "left_anti")
    both = f.alias("f").join(existing.alias("e"), cond).where(~F.col(f"f.{value}").eqNullSafe(F.col(f"e.{value}")))
    conflicts = both.select(*[F.col(f"e.{k}").alias(k) for k in key], F.col(f"e.{value}").alias("kept"), F.col(f"f.{value}").alias("fetched"))
    return existing.unionByName(add), add, conflicts


def rows_in_windows(df: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the windows (window, zone, variable[, psr_type], start, end) that they lie in: once for each.

    A window's psr_type is its rows'; a null one means all. Joined on zone and variable
    and by the windows' span.
    """
    w = windows if "psr_type" in windows.columns else windows.withColumn("psr_type", F.lit(None).cast("string"))
    hit = intervals.points_in(df, w.withColumnRenamed("psr_type", "_psr"), ["zone", "variable"], ts, "start", "end")
    return hit.where(F.col("_psr").isNull() | (F.col("_psr") == F.col("psr_type"))) if "psr_type" in df.columns else hit


def repair_windows(panel: DataFrame, fetched: DataFrame, windows: DataFrame, key: list[str], ts: str = "ts", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Merge fetched rows that lie in listed windows (see ``rows_in_windows``); and rows returned and added by window."""
    merged, add, _ = merge_requery(panel, rows_in_windows(fetched, windows, ts).select(fetched.columns).distinct(), key, value)
    in_w = lambda d: rows_in_windows(d, windows, ts).groupBy("window").agg(F.count("*").alias("n"))
    report = windows.select("window").join(in_w(fetched).withColumnRenamed("n", "rows_returned"), "window", "left").join(in_w(add).withColumnRenamed("n", "rows_added"), "window", "left")
    return merged, report.na.fill(0)


def tidy_members(df: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """Observed value and every member's forecast side by side."""
    return df.groupBy(*keys).pivot("member", members).agg(F.first("forecast")).join(df.groupBy(*keys).agg(F.max("observed").alias("actual")), keys)


def combine_predictions(tables: list[DataFrame], zone: str = "zone", ts: str = "ts") -> DataFrame:
    """One table of all zones' predictions, in the order of zone and stamp."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy(zone, ts)


def multi_zone_wide(df: DataFrame, zones: list[str], columns: list[str], zone: str = "zone", ts: str = "ts") -> DataFrame:
    """One row for each stamp that all zones have, with columns ``<zone>_<column>``; one shuffle for any number of zones."""
    there = F.count_distinct(F.when(F.col(zone).isin(*zones), F.col(zone)))
    picks = [F.first(F.when(F.col(zone) == z, F.col(c)), True).alias(f"{z}_{c}") for z in zones for c in columns]
    return df.groupBy(ts).agg(there.alias("_n"), *picks).where(F.col("_n") == len(zones)).drop("_n")


def hourly_predictions(days: DataFrame, observed: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Day arrays of an ensemble (keys, day, slots) to hours (keys, ts, forecast, observed); unobserved hours stay null."""
    flat = grid.flatten_day_matrix(days, keys).withColumnRenamed("value", "forecast").where("forecast IS NOT NULL")
    return flat.join(observed.select(*keys, F.col(ts).alias("ts"), "observed"), [*keys, "ts"], "left")


def write_members(df: DataFrame, path: str) -> None:
    """Member forecasts (kind, member, day, slot, forecast, ...), one folder for each member."""
    df.write.partitionBy("kind", "member").parquet(path)


def read_members(spark: SparkSession, path: str, keys: list[str], slots: int = 24) -> DataFrame:
    """Forecasts of a run's members on the days each has whole. A run of several kinds of members is an error; its folders tell."""
    df = spark.read.parquet(path)
    kinds = [r[0] for r in df.select("kind").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError(f"members of several kinds: {sorted(kinds)}")
    whole = df.groupBy("member", *keys, "day").agg(F.count("forecast").alias("_n")).where(F.col("_n") == slots)
    return df.join(whole, ["member", *keys, "day"], "left_semi")


def write_member_file(days: DataFrame, path: str, name: str, slots: int = 24) -> None:
    """One member's day arrays (day, slots) as a CSV of a column an hour: ``<name>.csv``, the name's number is the member's."""
    days.select("day", *[F.get("slots", F.lit(i)).alias(f"h{i}") for i in range(slots)]).coalesce(1).write.csv(f"{path}/{name}.csv", header=True)


def read_member_files(spark: SparkSession, path: str, kinds: dict[str, str], kind: str | None = None, slots: int = 24) -> DataFrame:
    """(kind, member, day, slot, forecast) of a run's member files, named ``<prefix><number>.csv``, on the days each has whole.

    ``kinds`` maps prefixes to kinds of members. Files of several kinds are an error unless
    ``kind`` says which to read; names of another form are passed over; without files
    there are no rows.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.csv")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    names = [m for s in found if (m := re.fullmatch(r"([A-Za-z_]*?)(\d+)\.csv", s.getPath().getName())) and m[1] in kinds]
    there = sorted({kinds[m[1]] for m in names})
    if kind is None and len(there) > 1:
        raise ValueError(f"{path} holds members of kinds {' and '.join(there)}")
    names = [m for m in names if kind in (None, kinds[m[1]])]
    hours = [f"h{i}" for i in range(slots)]
    schema = "day date, " + ", ".join(f"{h} double" for h in hours)
    if not names:
        return spark.createDataFrame([], "kind string, member int, day date, slot int, forecast double")
    df = spark.read.csv([f"{path}/{m[0]}" for m in names], schema=schema, header=True).select("*", F.regexp_extract("_metadata.file_path", r"/([A-Za-z_]*?)(\d+)\.csv", 1).alias("_p"), F.regexp_extract("_metadata.file_path", r"/[A-Za-z_]*?(\d+)\.csv", 1).cast("int").alias("member"))
    whole = df.where(F.greatest(*[F.col(h).isNull() for h in hours]) == F.lit(False))
    label = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("_p")]
    return whole.select(label.alias("kind"), "member", "day", F.posexplode(F.array(*hours)).alias("slot", "forecast"))


def mixed_kinds(df: DataFrame, member: str = "member", kind: str = "kind") -> DataFrame:
    """Member kinds of a run beyond the first: a run of several is refused."""
    kinds = df.groupBy(kind).agg(F.count_distinct(member).alias("members"))
    return kinds.crossJoin(kinds.agg(F.min(kind).alias("_first"))).where(F.col(kind) != F.col("_first")).drop("_first")


def split_joint_forecast(df: DataFrame, keys: list[str], zones: list[str], slots: int = 24, array: str = "joint") -> DataFrame:
    """Rows of ``slots`` times zones values to one row for each zone and slot."""
    d = df.select(*keys, F.posexplode(array).alias("_p", "forecast"))
    z = F.element_at(F.array(*[F.lit(x) for x in zones]), (F.floor(F.col("_p") / slots) + 1).cast("int"))
    return d.select(*keys, z.alias("zone"), (F.col("_p") % slots).alias("slot"), "forecast")
