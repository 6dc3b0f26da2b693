"""Scalar functions that Spark lacks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.arrow_udf(DoubleType())
def norm_cdf(x: pa.Array) -> pa.Array:
    """Standard normal distribution function; applied to the few rows of a test's result."""
    return pa.array([None if v is None else 0.5 * math.erfc(-v / math.sqrt(2)) for v in x.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def norm_sf(x: pa.Array) -> pa.Array:
    """Upper tail of the standard normal, without loss for small values."""
    return pa.array([None if v is None else 0.5 * math.erfc(v / math.sqrt(2)) for v in x.to_pylist()], pa.float64())


def chi2_sf_2(x: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom; 1 below 0."""
    return F.when(x >= 0, F.exp(-x / 2)).otherwise(F.lit(1.0))
