"""Sums of products of many series at common stamps, by tiles.

Series are numbered and cut into blocks of BLOCK; the values of a block in a bucket of
time are one matrix (stamps by series, NaN where there is none). A tile is a pair of
blocks: its matrices meet bucket by bucket and add to running sums of products, so no
row is made for a pair and a stamp, and a task holds two matrices and one tile's sums.
A bucket's values of one series at each stamp must be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators import carry

#: Series of a block.
BLOCK = 256


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal values in the first ``n_keys`` columns; rows come sorted by them."""
    held, now = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != now:
                    if held:
                        yield now, pa.Table.from_batches(held)
                    held, now = [], keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield now, pa.Table.from_batches(held)


def _pack(size: int) -> Callable:
    """One matrix for each block and bucket, and its stamps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, bucket), t in runs(batches, 2):
            stamps, row = np.unique(t.column("t").to_numpy(), return_inverse=True)
            m = np.full((len(stamps), size), np.nan)
            m[row, t.column("pos").to_numpy()] = t.column("v").to_numpy()
            yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket], "stamps": [stamps.tobytes()], "m": [m.tobytes()]})

    return run


def _matrix(raw: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(present as 0 or 1, values with 0 where there is none)."""
    m = np.frombuffer(raw).reshape(rows, -1)
    there = ~np.isnan(m)
    return there.astype(float), np.where(there, m, 0.0)


def products(ma: np.ndarray, a: np.ndarray, mb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, sums, sums of squares and of products of every column of ``a`` with every one of ``b`` over their common rows."""
    return np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each tile over a task's buckets; the left block comes before the right one."""
    for (i, j, _), t in _by_tile(batches):
        yield pa.RecordBatch.from_pydict({"i": [i], "j": [j], "sums": [t.tobytes()]})


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    now, total, left = None, None, None
    for batch in batches:
        for i, j, g, bucket, role, stamps, m in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            if (i, j, g) != now:
                if total is not None:
                    yield now, total
                now, total, left = (i, j, g), None, None
            at = np.frombuffer(stamps, np.int64)
            if role == 0:
                left = (bucket, at, *_matrix(m, len(at)))
                if i != j:
                    continue
            if left is None or left[0] != bucket:
                continue
            mb, b = _matrix(m, len(at))
            _, x, y = np.intersect1d(left[1], at, assume_unique=True, return_indices=True)
            part = products(left[2][x], left[3][x], mb[y], b[y])
            total = part if total is None else total + part
    if total is not None:
        yield now, total


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a pair (numbers a <= b) from the partial sums of its tile."""
    now, total = None, None

    def rows() -> pa.RecordBatch:
        size = int((len(total) / 6) ** 0.5)
        n, sa, sb, saa, sbb, sab = total.reshape(6, size, size)
        a, b = np.nonzero(n > 0)
        keep = a + now[0] * size <= b + now[1] * size
        a, b = a[keep], b[keep]
        n, sa, sb, saa, sbb, sab = (x[a, b] for x in (n, sa, sb, saa, sbb, sab))
        with np.errstate(divide="ignore", invalid="ignore"):
            sxy, sxx, syy = sab - sa * sb / n, saa - sa * sa / n, sbb - sb * sb / n
            cov, corr = sxy / (n - 1), sxy / np.sqrt(sxx * syy)
        tiny = (sxx <= 1e-12 * saa) | (syy <= 1e-12 * sbb)  # constant but for rounding
        return pa.RecordBatch.from_pydict({
            "na": (a + now[0] * size).astype(np.int64), "nb": (b + now[1] * size).astype(np.int64), "obs": n.astype(np.int64),
            "cov": pa.array(cov, mask=n < 2), "corr": pa.array(corr, mask=(n < 2) | tiny | ~np.isfinite(corr)),
        })

    for batch in batches:
        for i, j, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if (i, j) != now:
                if now:
                    yield rows()
                now, total = (i, j), 0
            total = total + np.frombuffer(raw)
    if now:
        yield rows()


def pairwise(df: DataFrame, series: str, ts: str = "ts", value: str = "value", width: int = carry.WIDTH, block: int = BLOCK) -> DataFrame:
    """(a, b, cov, corr, obs): covariance, correlation and number of common stamps of each pair of series (a <= b) that has any.

    Null where they are not defined: a single common stamp, or a constant series. Values
    are taken from each series' mean first, so that large levels do not cost digits.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(series).alias("s"), F.col(ts).alias("_ts"), F.col(value).cast("double").alias("v"))
    ids = d.groupBy("s").agg(F.avg("v").alias("mean")).withColumn("no", F.row_number().over(Window.orderBy("s")) - 1)
    cells = d.withColumn("bucket", carry.bucket_of(d, "_ts", width)).join(ids, "s")
    cells = cells.select(F.floor(F.col("no") / block).alias("block"), "bucket", (F.col("no") % block).cast("long").alias("pos"), _number(d, "_ts").alias("t"), (F.col("v") - F.col("mean")).alias("v"))
    packs = cells.repartition("block", "bucket").sortWithinPartitions("block", "bucket").mapInArrow(_pack(block), "block long, bucket long, stamps binary, m binary")
    blocks = ids.agg(F.coalesce(F.floor(F.max("no") / block), F.lit(0)).alias("last"))  # one row
    tiles = packs.crossJoin(F.broadcast(blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    # few tiles share their buckets between tasks
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    share = F.greatest(F.lit(1), F.ceil(F.lit(2.0 * df.sparkSession.sparkContext.defaultParallelism) / ((F.col("last") + 1) * (F.col("last") + 2) / 2)))
    tiles = tiles.select(lo.alias("i"), hi.alias("j"), F.pmod("bucket", share).alias("g"), "bucket", F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("role"), "stamps", "m")
    sums = tiles.repartition("i", "j", "g").sortWithinPartitions("i", "j", "g", "bucket", "role").mapInArrow(_tiles, "i long, j long, sums binary")
    pairs = sums.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_sum, "na long, nb long, obs long, cov double, corr double")
    name = lambda c: ids.select(F.col("no").cast("long").alias(f"n{c}"), F.col("s").alias(c))
    return pairs.join(name("a"), "na").join(name("b"), "nb").select("a", "b", "cov", "corr", "obs")


def _number(df: DataFrame, ts: str) -> Column:
    """A stamp, date or whole number as a number of its own."""
    kind = df.schema[ts].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    return F.col(ts).cast("long")


def rolling_gram(rows: DataFrame, asked: DataFrame, own: str, ts: str, vector: str, start: str, solve: Callable[[np.ndarray], dict], schema: str, width: int = carry.WIDTH // 4) -> DataFrame:
    """For each row of ``asked`` (own, run, start), ``solve`` of the Gram matrix of the vectors of ``rows`` (own, ts, vector) before ``start``.

    Vectors of one ``own`` have one length and no nulls. A bucket's rows become one matrix
    of sums; a task passes over the matrices of one ``own`` in order and answers what is
    asked; rows of the bucket that a start lies in are summed for that start alone.
    ``solve`` returns a row's values; ``schema`` names their columns.
    """
    b = carry.bucket_of(rows, ts, width)
    part = rows.select(F.col(own).alias("own"), b.alias("bucket"), F.col(vector).alias("z"))
    part = part.repartition("own", "bucket").sortWithinPartitions("own", "bucket").mapInArrow(_sum_rows(2), "own string, bucket long, gram binary")
    a = asked.select(F.col(own).alias("own"), carry.bucket_of(asked, start, width).alias("bucket"), "run", F.col(start).alias("_start"))
    near = a.join(rows.select(F.col(own).alias("own"), b.alias("bucket"), F.col(ts).alias("_t"), F.col(vector).alias("z")), ["own", "bucket"]).where("_t < _start")
    near = near.select("own", "bucket", "run", "z").repartition("own", "bucket", "run").sortWithinPartitions("own", "bucket", "run").mapInArrow(_sum_rows(3), "own string, bucket long, run long, gram binary")
    a = a.drop("_start").join(near, ["own", "bucket", "run"], "left")
    both = a.withColumn("_kind", F.lit(0)).unionByName(part.withColumns({"_kind": F.lit(1), "run": F.lit(None).cast("long")}))
    both = both.select("own", "bucket", "_kind", "run", "gram").repartition("own").sortWithinPartitions("own", "bucket", "_kind", "run")
    return both.mapInArrow(_answer(solve), f"own string, run long, {schema}")


def _sum_rows(n_keys: int) -> Callable:
    """The Gram matrix of each run of equal keys; vectors stand in column ``z``, keys before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for key, t in runs(iter([batch]), n_keys):
                z = t.column("z").combine_chunks()
                m = z.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                if key != now:
                    if now:
                        yield _row(t.schema.names, now, total)
                    now, total = key, 0
                total = total + m.T @ m
        if now:
            yield _row(batch.schema.names, now, total)

    return run


def _row(names: list[str], key: tuple, total: np.ndarray) -> pa.RecordBatch:
    kinds = {"own": pa.string(), "bucket": pa.int64(), "run": pa.int64()}
    return pa.RecordBatch.from_arrays([*(pa.array([k], kinds[n]) for n, k in zip(names, key, strict=False)), pa.array([total.tobytes()])], names=[*names[: len(key)], "gram"])


def _answer(solve: Callable[[np.ndarray], dict]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            out = []
            for own, _, kind, r, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != now:
                    now, total = own, None
                m = None if raw is None else np.frombuffer(raw)
                if kind:
                    total = m if total is None else total + m
                elif m is not None or total is not None:
                    g = total if m is None else m if total is None else total + m
                    n = int(len(g) ** 0.5)
                    out.append({"own": own, "run": r} | solve(g.reshape(n, n)))
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return run
