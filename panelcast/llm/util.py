"""Shared folder, staged tables and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each row in a filter of rows, and most bits in all as a power of two.
FILTER_SHARE, FILTER_BITS = 16, 26
_OWN: dict[str, str] = {}


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and their neighbours need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many underscores before it as make it none of ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local master one of our own where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _OWN.get(spark.sparkContext.applicationId) or _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="panelcast-"))
    return d.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/panelcast-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{uuid.uuid4().hex}/{name}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has staged: once its results are read or written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, units: int | None, most: int, least: int) -> int:
    """Tasks for so many units of work: at most ``most`` in each, and work for all cores where that leaves ``least`` in each."""
    u = units or 0
    return max(1, -(-u // most), min(-(-u // least), 2 * spark.sparkContext.defaultParallelism))


def chance(*cols: Column | str) -> Column:
    """A number from 0 to below 1 that a hash of the columns gives, in steps of 2**-53: a sample's share may be as small."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def join_hot(df: DataFrame, dim: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join with a table of one row a key, where one key may hold a third of ``df``: keys are dealt to ``salts`` tasks each.

    Spark takes the salted table for about as large as ``dim``'s files and would broadcast
    ``salts`` times as many rows as it means to, all of them by the driver's memory.
    """
    s = fresh("_salt", [*df.columns, *dim.columns])
    own = df.withColumn(s, F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    salted = dim.withColumn(s, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return own.join(salted.hint("merge"), [key, s], "left").drop(s)


def filter_bits(rows: int) -> int:
    """Bits of a filter of so many rows, as a power of two."""
    return max(16, min(FILTER_BITS, int(np.log2(max(FILTER_SHARE * rows, 1)))))


def filter_slot(bits: int, *cols: Column | str) -> Column:
    """A row's bit in a filter."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits))


def filter_flags(slots: DataFrame, bits: int) -> np.ndarray:
    """A filter as bytes, from its rows' ``slot``; at most 2**FILTER_BITS / 32768 rows of 4 KB reach the driver."""
    slots = slots.select((F.col("slot") + 1).alias("s"))  # bit s - 1 stands for s
    maps = slots.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    flags = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for m in maps:
        first = (m["bucket"] - 1) * 4096
        flags[first : first + 4096] = np.frombuffer(m["bits"], np.uint8)
    return flags


def in_filter(flags: np.ndarray, slot: pa.Array) -> np.ndarray:
    """Whether each slot's bit is set."""
    slot = slot.to_numpy(zero_copy_only=False)
    return ((flags[slot >> 3] >> (slot & 7)) & 1).astype(bool)


def may_be_in(rows: DataFrame, *cols: str) -> Callable[..., Column]:
    """A test of columns of the same types as ``cols``: true for all that stand in ``rows``, false for most others, so that a join need not shuffle these."""
    bits = filter_bits(rows.count())
    held = rows.sparkSession.sparkContext.broadcast(filter_flags(rows.select(filter_slot(bits, *cols).alias("slot")), bits))

    @F.arrow_udf("boolean")
    def run(slot: pa.Array) -> pa.Array:
        return pa.array(in_filter(held.value, slot))

    return lambda *c: run(filter_slot(bits, *c))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (a, b): (node, comp).

    Minimum labels travel along edges and labels jump to their label's label, so
    rounds grow with the logarithm of a path's length. Both steps are equi-joins
    and partial minima; a node with a third of all edges is split by adaptive
    execution. Empty edges give no rows; nulls must be filtered before.
    """
    e = edges.select("a", "b").where("a <> b")
    e = stage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    lab = stage(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    last = None
    while True:
        seen = e.join(lab.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("comp"))
        low = lab.unionByName(seen).groupBy("node").agg(F.min("comp").alias("comp"))
        up = lab.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        nxt = stage(low.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        now = nxt.agg(F.bit_xor(F.xxhash64("node", "comp")).alias("x"), F.count("*").alias("n")).first()
        if now == last or now["n"] == 0:
            return nxt
        last, lab = now, nxt
