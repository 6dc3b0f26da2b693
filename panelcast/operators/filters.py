"""Projections, filters and predicates of panels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production type codes of the public transparency platform and their names.
PSR_NAMES = {
    "B01": "Biomass",
    "B02": "Fossil Brown coal/Lignite",
    "B03": "Fossil Coal-derived gas",
    "B04": "Fossil Gas",
    "B05": "Fossil Hard coal",
    "B06": "Fossil Oil",
    "B07": "Fossil Oil shale",
    "B08": "Fossil Peat",
    "B09": "Geothermal",
    "B10": "Hydro Pumped Storage",
    "B11": "Hydro Run-of-river and poundage",
    "B12": "Hydro Water Reservoir",
    "B13": "Marine",
    "B14": "Nuclear",
    "B15": "Other renewable",
    "B16": "Solar",
    "B17": "Waste",
    "B18": "Wind Offshore",
    "B19": "Wind Onshore",
    "B20": "Other",
    "B21": "AC Link",
    "B22": "DC Link",
    "B23": "Substation",
    "B24": "Transformer",
    "B25": "Energy storage",
}
#: Columns of the named layouts, each (name, variable, production types or none); price first.
_PRICE, _LOAD, _HYDRO = ("price", "price", ()), ("load", "load_forecast", ()), ("hydro", "reservoir", ())
_WIND = ("wind", "generation_forecast", ("wind_onshore", "wind_offshore"))
_SOLAR = ("solar", "generation_forecast", ("solar",))
_BOTH = ("windsolar", "generation_forecast", ("wind_onshore", "wind_offshore", "solar"))
LAYOUTS = {
    "load-windsolar": [_PRICE, _LOAD, _BOTH],
    "load-wind-solar": [_PRICE, _LOAD, _WIND, _SOLAR],
    "load-wind": [_PRICE, _LOAD, _WIND],
    "load-windsolar-hydro": [_PRICE, _LOAD, _BOTH, _HYDRO],
    "load-wind-hydro": [_PRICE, _LOAD, _WIND, _HYDRO],
    "load-wind-solar-hydro": [_PRICE, _LOAD, _WIND, _SOLAR, _HYDRO],
}


def canonical_keys(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Nulls of key columns become '': joins and groups then treat them as one value."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols})


def decode(code: Column, names: dict[str, str]) -> Column:
    """Name of a code; unknown codes pass through."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), code)


def series_key(zone: Column, variable: Column, psr: Column) -> Column:
    """``zone | variable [psr]``, without the bracket where psr is empty."""
    return F.concat(zone, F.lit(" | "), variable, F.when(F.coalesce(psr, F.lit("")) != "", F.concat(F.lit(" ["), psr, F.lit("]"))).otherwise(F.lit("")))


def exclude_product(df: DataFrame, **named: str) -> DataFrame:
    """Drop rows that match all named values (null-safe)."""
    cond = F.lit(True)
    for c, v in named.items():
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return df.where(~cond)


def local_window(ts: Column, start: str, end: str, tz: str) -> Column:
    """Half-open UTC predicate on a naive UTC stamp from naive local bounds; literals, so it reaches the scan."""

    def utc(s: str) -> Column:
        return F.to_utc_timestamp(F.lit(s).cast("timestamp"), tz).cast("timestamp_ntz")

    return (ts >= utc(start)) & (ts < utc(end))


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself; an error if it has no row."""
    if not df.limit(1).count():
        raise ValueError(f"nothing left: {what}")
    return df


def filter_psr(df: DataFrame, *codes: str, psr: str = "psr_type") -> DataFrame:
    return non_empty(df.where(F.col(psr).isin(*codes)), f"{psr} in {codes}")


def prefer_contract(df: DataFrame, keys: list[str], contract: str = "A01", col: str = "contract_type") -> DataFrame:
    """Only rows of the contract type where a key has any, else all of the key's rows."""
    has = df.groupBy(*keys).agg(F.max((F.col(col) == contract).cast("int")).alias("_has"))
    return df.join(has, keys).where((F.coalesce("_has", F.lit(0)) == 0) | (F.col(col) == contract)).drop("_has")


def drop_zones(df: DataFrame, dim: DataFrame, zones: list[str], zone: str = "zone") -> DataFrame:
    """Rows whose zone is in the dimension and not listed."""
    return df.join(dim.select(zone).distinct(), zone, "left_semi").where(~F.col(zone).isin(*zones))


def drop_series(df: DataFrame, unwanted: DataFrame) -> DataFrame:
    return df.join(unwanted.distinct(), unwanted.columns, "left_anti")


def drop_near_constant(df: DataFrame, keys: list[str], value: str = "value", max_pct_zero: float = 90.0) -> DataFrame:
    """Drop series of which more than ``max_pct_zero`` percent of values are zero (below 1e-9)."""
    share = df.groupBy(*keys).agg((F.avg((F.abs(value) < 1e-9).cast("double")) * 100).alias("pct"))
    return drop_series(df, share.where(F.col("pct") > max_pct_zero).select(*keys))


def drop_late_series(df: DataFrame, keys: list[str], start: Column, ts: str = "ts") -> DataFrame:
    """Drop series whose first stamp lies after ``start``."""
    return drop_series(df, df.groupBy(*keys).agg(F.min(ts).alias("_first")).where(F.col("_first") > start).select(*keys))


def truncate_at(df: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) <= cutoff)


def trim_start(df: DataFrame, start: Column, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= start)


def unit_label(unit: Column) -> Column:
    """MAW is the platform's code of MW."""
    return F.when(unit == "MAW", F.lit("MW")).otherwise(unit)


def with_unit(df: DataFrame, keys: list[str], currency: str, measure: str) -> DataFrame:
    """Adds ``unit`` for each key: its least currency/measure (a key has one), or the measure alone."""
    u = df.groupBy(*keys).agg(F.min(currency).alias("_c"), F.min(measure).alias("_m"))
    return df.join(u.select(*keys, F.concat_ws("/", "_c", unit_label(F.col("_m"))).alias("unit")), keys)


def project_layout(df: DataFrame, layout: dict[str, tuple[str, tuple[str, ...]]], by: list[str], variable: str = "variable", psr: str = "psr_type", value: str = "value") -> DataFrame:
    """One column for each (variable, psr codes) of the layout, summed; all zones in one pass."""
    cols = []
    for name, (var, codes) in layout.items():
        cond = F.col(variable) == var
        if codes:
            cond = cond & F.col(psr).isin(*codes)
        cols.append(F.sum(F.when(cond, F.col(value))).alias(name))
    return df.groupBy(*by).agg(*cols)


def named_layout(df: DataFrame, layout: str, by: list[str], zone: str = "zone", variable: str = "variable", psr: str = "psr_type", value: str = "value") -> DataFrame:
    """The columns of a named layout for all zones in one pass, by ``by`` (zone and stamp).

    A column of several production types is null where one that the zone has is missing
    at the stamp; types that the zone never has do not count.
    """
    cols, own = [], []
    for name, var, codes in LAYOUTS[layout]:
        cond = (F.col(variable) == var) & (F.col(psr).isin(*codes) if codes else F.lit(True))
        part = F.coalesce(F.col(psr), F.lit("")) if codes else F.lit("")
        cols += [F.sum(F.when(cond, F.col(value))).alias(f"_s_{name}"), F.count_distinct(F.when(cond & F.col(value).isNotNull(), part)).alias(f"_c_{name}")]
        own.append(F.count_distinct(F.when(cond, part)).alias(f"_n_{name}"))
    g = df.groupBy(*by).agg(*cols).join(df.groupBy(zone).agg(*own), zone)
    return g.select(*by, *[F.when(F.col(f"_c_{n}") >= F.greatest(F.col(f"_n_{n}"), F.lit(1)), F.col(f"_s_{n}")).alias(n) for n, *_ in LAYOUTS[layout]])


def component_sum(df: DataFrame, keys: list[str], component: str, value: str = "value") -> DataFrame:
    """Sum of all components that the keys (but the last, the stamp) have; null where one is missing."""
    n = df.groupBy(*keys[:-1]).agg(F.count_distinct(component).alias("_n"))
    s = df.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    return s.join(n, keys[:-1]).select(*keys, F.when(F.col("_c") >= F.col("_n"), F.col("_s")).alias("total"))


def missing_components(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (zone, variable, psr_type, ...) that the panel has nothing of; ``zones_without`` tells zones without any series."""
    return wanted.join(df.select(wanted.columns).distinct(), wanted.columns, "left_anti")


def zones_without(df: DataFrame, wanted: DataFrame, zone: str = "zone") -> DataFrame:
    """Zones of ``wanted`` of which the panel has no row at all."""
    return wanted.select(zone).distinct().join(df.select(zone).distinct(), zone, "left_anti")


def panel_zones(df: DataFrame, variable: str, zone: str = "zone", col: str = "variable") -> DataFrame:
    """Every zone and whether it has the variable."""
    return df.groupBy(zone).agg(F.bool_or(F.col(col) == variable).alias("has_variable"))

