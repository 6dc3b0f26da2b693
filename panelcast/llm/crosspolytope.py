"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe tables.

A vector is scaled by the largest norm of its band (norms within a factor of two) and
gets one more component that makes it a unit vector, so that the largest inner product
is the smallest angle. Each table rotates it by three rounds of random signs and the fast
Hadamard transform and takes the nearest signed axis; enough rotations are concatenated
that a cell holds few vectors. A query probes every cell whose axes are within WIDTH of
its own nearest ones, and the candidates of all tables are ranked by the inner product
of the original vectors. WIDTH is not guessed: the true neighbours of a bounded sample of
queries say how wide probing must be to reach FOUND of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.topk import usable
from panelcast.llm.util import stage, tasks

#: Tables, and vectors of a cell on average from which one more rotation is concatenated.
TABLES, CELL = 4, 64
#: Vectors of a block: cells that stand together, or a share of a full cell.
GROUP = 4096
#: Queries (of each dimension) whose true neighbours set the width, and the share of them that probing reaches.
SAMPLE, FOUND = 96, 0.955
#: Rows of results that a task holds before it gives them away.
HELD = 1 << 20


def width(dim: int) -> int:
    """Components of a rotated vector: a power of two with room for one more component."""
    return 1 << dim.bit_length()


def hadamard(a: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of the rows."""
    rows, n, h = *a.shape, 1
    while h < n:
        b = a.reshape(rows, n // (2 * h), 2, h)
        a = np.stack([b[:, :, 0] + b[:, :, 1], b[:, :, 0] - b[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return a / math.sqrt(n)


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Pseudo-rotation of rows of ``width`` components: the same for all tasks."""
    r = np.random.default_rng([table, part, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * r.choice([-1.0, 1.0], x.shape[1]))
    return x


def on_sphere(x: np.ndarray, most: float) -> np.ndarray:
    """Rows over the largest norm, completed to unit vectors and padded."""
    x = x / most
    out = np.zeros((len(x), width(x.shape[1])))
    out[:, : x.shape[1]] = x
    out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
    return out


def directions(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, padded."""
    out = np.zeros((len(q), width(q.shape[1])))
    out[:, : q.shape[1]] = q / np.abs(q).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def cells(unit: np.ndarray, parts: int) -> np.ndarray:
    """(rows x tables) cell numbers: the nearest signed axes of each table's rotations."""
    d, out = unit.shape[1], np.zeros((len(unit), TABLES), np.int64)
    for t in range(TABLES):
        for p in range(parts):
            y = rotated(unit, t, p)
            at = np.abs(y).argmax(1)
            out[:, t] = out[:, t] * 2 * d + at + d * (y[np.arange(len(y)), at] < 0)
    return out


def gaps(unit: np.ndarray, table: int, parts: int) -> list[np.ndarray]:
    """For each rotation, how much farther each signed axis is than the nearest one: (rows x 2 width)."""
    out = []
    for p in range(parts):
        y = rotated(unit, table, p)
        both = np.concatenate([y, -y], 1)
        out.append(both.max(1, keepdims=True) - both)
    return out


def probes(gap: list[np.ndarray], row: int, wide: float) -> np.ndarray:
    """Cells whose summed gaps are at most ``wide``, ascending."""
    far, cell = np.zeros(1), np.zeros(1, np.int64)
    for g in gap:
        near = np.flatnonzero(g[row] <= wide)
        s = far[:, None] + g[row][near]
        i, j = np.nonzero(s <= wide)
        far, cell = s[i, j], cell[i] * g.shape[1] + near[j]
    return np.sort(cell)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    at = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(at[:-1], at[1:], strict=True)) if n else []


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add dim, norm and band (the norm's nearest power of two)."""
    for batch in batches:
        vec = batch.column("vec")
        dim = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        v = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.concatenate([[0], np.cumsum(dim)[:-1]]).astype(np.int64)
        top = np.maximum.reduceat(np.abs(v), start) if len(v) else np.zeros(0)
        norm = top * np.sqrt(np.add.reduceat((v / np.repeat(top, dim)) ** 2, start)) if len(v) else top
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        yield pa.RecordBatch.from_pydict(cols | {"dim": dim, "norm": norm, "band": np.rint(np.log2(norm)).astype(np.int64)})


def _top(q: np.ndarray, x: np.ndarray, f: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (ties: smaller f, the smallest id of x) of each q, without repeated pairs."""
    o = np.lexsort((x, f, -s, q))
    q, x, f, s = q[o], x[o], f[o], s[o]
    if len(q):
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])])
        q, x, f, s = q[new], x[new], f[new], s[new]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        at = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        q, x, f, s = q[at < k], x[at < k], f[at < k], s[at < k]
    return q, x, f, s


_FOUND = "q long, x long, f long, s double"


def _found(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("q", "x", "f", "s"), rows, strict=True)))


def best_of(q: np.ndarray, block: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of block, inner product) of each query's k best allowed rows, in double precision."""
    s = q @ block.T
    if allowed is not None:
        s[~allowed] = -np.inf
    n = min(k, s.shape[1])
    at = np.argpartition(-s, n - 1, axis=1)[:, :n]
    low = np.take_along_axis(s, at, 1).min(1, keepdims=True)
    r, c = np.nonzero((s >= low) & (s > -np.inf))  # ties with the last stay: ids decide later
    return r, c, (q[r] * block[c]).sum(1)


def _true(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k best of each sampled query among a task's vectors, other than equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0))
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for a, b in _runs(dims):
                if int(dims[a]) in sample:
                    ids, q = sample[int(dims[a])]
                    own, first = (batch.column(n).slice(a, b - a).to_numpy() for n in ("rep", "first"))
                    r, c, s = best_of(q, _matrix(batch.column("vec").slice(a, b - a), int(dims[a])), ids[:, None] != own, k)
                    held = _top(*(np.concatenate(p) for p in zip(held, (ids[r], own[c], first[c], s), strict=True)), k)
        yield _found(held)

    return run


def _hash(parts: dict[int, int], most: dict[tuple[int, int], float]):
    """Add each vector's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bands, out = batch.column("dim").to_numpy(), batch.column("band").to_numpy(), np.zeros((len(batch), TABLES), np.int64)
            for d, w in {*zip(dims.tolist(), bands.tolist(), strict=True)}:
                at = np.flatnonzero((dims == d) & (bands == w))
                out[at] = cells(on_sphere(_matrix(batch.column("vec").take(pa.array(at)), d), most[d, w]), parts[d])
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield pa.RecordBatch.from_pydict(cols | {"cells": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), TABLES).cast(pa.list_(pa.int64()))})

    return run


def _probe(parts: dict[int, int], span: dict[int, int], wide: dict[int, float]):
    """A row for each query, table and group of cells that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, reps, vecs = batch.column("dim").to_numpy(), batch.column("rep").to_numpy(), batch.column("vec")
            for d in sorted({*dims.tolist()}):
                at = np.flatnonzero(dims == d)
                for few in np.array_split(at, -(-len(at) // 512)):
                    unit, out = directions(_matrix(vecs.take(pa.array(few)), d)), {"at": [], "tab": [], "grp": [], "cell": []}
                    for t in range(TABLES):
                        gap = gaps(unit, t, parts[d])
                        for i in range(len(few)):
                            cell = probes(gap, i, wide[d])
                            grp = cell // span[d]
                            for a, b in _runs(grp):
                                for name, v in (("at", few[i]), ("tab", t), ("grp", grp[a]), ("cell", cell[a:b].tobytes())):
                                    out[name].append(v)
                    rows = pa.array(np.array(out["at"], np.int64))
                    yield pa.RecordBatch.from_pydict({"dim": np.full(len(rows), d), "tab": np.array(out["tab"], np.int64), "grp": np.array(out["grp"], np.int64), "rep": pa.array(reps).take(rows), "vec": vecs.take(rows), "cell": pa.array(out["cell"], pa.binary())})

    return run


def _score(k: int):
    """Each query's k best candidates of a task's blocks; a block's vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, firsts, cell, vecs, held = None, [], [], [], [], []

        def taken() -> tuple[np.ndarray, ...]:
            return _top(*(np.concatenate(c) for c in zip(*held, strict=True)), k)

        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("dim", "band", "tab", "grp", "sub", "kind")]
            for a, b in _runs(*key):
                block, kind, dim = tuple(int(c[a]) for c in key[:5]), int(key[5][a]), int(key[0][a])
                if block != now:
                    now, ids, firsts, cell, vecs = block, [], [], [], []
                own, m = batch.column("rep").slice(a, b - a).to_numpy(), _matrix(batch.column("vec").slice(a, b - a), dim)
                if kind == 0:
                    ids.append(own)
                    firsts.append(batch.column("first").slice(a, b - a).to_numpy())
                    cell.append(batch.column("no").slice(a, b - a).to_numpy())
                    vecs.append(m)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, firsts, cell, vecs = [np.concatenate(ids)], [np.concatenate(firsts)], [np.concatenate(cell)], [np.concatenate(vecs)]
                raw, (kinds, local) = batch.column("cell").slice(a, b - a).to_pylist(), np.unique(cell[0], return_inverse=True)
                for at in range(0, len(own), 256):
                    probed = [np.frombuffer(x, np.int64) for x in raw[at : at + 256]]
                    allowed = np.stack([np.isin(kinds, x, assume_unique=True) for x in probed])
                    r, c, s = best_of(m[at : at + 256], vecs[0], allowed[:, local], k)
                    held.append((own[at + r], ids[0][c], firsts[0][c], s))
                if sum(len(x[0]) for x in held) > 2 * HELD:
                    held = [taken()]
                    if len(held[0][0]) > HELD:
                        yield _found(held[0])
                        held = []
        if held:
            yield _found(taken())

    return run


_KEY = ["dim", "band", "tab", "grp", "sub"]


def _search(hashed: DataFrame, queries: DataFrame, parts: dict[int, int], wide: dict[int, float], span: dict[int, int], n: int, k: int) -> DataFrame:
    """(q, x, f, s): the k best candidates found for each query of ``queries`` (rep, dim, vec)."""
    data = hashed.select("rep", "first", "dim", "band", "vec", F.posexplode("cells").alias("tab", "no"))
    spans = F.create_map(*[F.lit(int(x)).cast("long") for d in span.items() for x in d])
    data = data.withColumn("tab", F.col("tab").cast("long")).withColumn("grp", F.floor(F.col("no") / spans[F.col("dim")]))
    full = stage(data.groupBy("dim", "band", "tab", "grp").agg(F.ceil(F.count("*") / GROUP).alias("subs")), "groups")
    data = data.join(full, ["dim", "band", "tab", "grp"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")))
    cols = [*_KEY, "kind", "rep", "first", "no", "vec", "cell"]
    data = data.withColumns({"cell": F.lit(None).cast("binary"), "kind": F.lit(0)}).select(cols)
    ask = queries.select("rep", "dim", "vec").mapInArrow(_probe(parts, span, wide), f"dim long, tab long, grp long, rep long, vec {queries.schema['vec'].dataType.simpleString()}, cell binary")
    ask = ask.join(full, ["dim", "tab", "grp"]).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).withColumns({"kind": F.lit(1), "first": F.lit(0).cast("long"), "no": F.lit(0).cast("long")}).select(cols)
    rows = data.unionByName(ask).repartition(tasks(hashed.sparkSession, n * TABLES, 64 * GROUP, GROUP), *_KEY).sortWithinPartitions(*_KEY, "kind")
    return rows.mapInArrow(_score(k), _FOUND)


def _width_needed(reps: DataFrame, parts: dict[int, int], most: dict[tuple[int, int], float], k: int) -> dict[int, float]:
    """How wide probing must be, by dimension, to meet FOUND of the sampled queries' true neighbours; wide open without any."""
    pick = F.row_number().over(Window.partitionBy("dim").orderBy("h1", "h2"))
    rows = reps.where("is_query").withColumn("n", pick).where(F.col("n") <= SAMPLE).select("rep", "dim", "vec").collect()
    sample = {d: (np.array([r["rep"] for r in rows if r["dim"] == d]), np.array([r["vec"] for r in rows if r["dim"] == d], np.float64)) for d in parts if any(r["dim"] == d for r in rows)}
    best = reps.select("rep", "first", "dim", "vec").mapInArrow(_true(sample, k), _FOUND)
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "f", "x"))).where(F.col("n") <= k)
    met = best.join(reps.select(F.col("rep").alias("x"), "dim", "band", "vec"), "x").collect()  # at most SAMPLE * k vectors a dimension
    out = {d: math.inf for d in parts}
    for d, (ids, q) in sample.items():
        mine, at = [r for r in met if r["dim"] == d], {int(i): n for n, i in enumerate(ids)}
        if mine:
            cell = np.concatenate([cells(on_sphere(np.array([r["vec"]], np.float64), most[d, r["band"]]), parts[d]) for r in mine])
            row, low = np.array([at[r["q"]] for r in mine]), np.full(len(mine), np.inf)
            for t in range(TABLES):
                far, code = np.zeros(len(mine)), cell[:, t]
                for g in reversed(gaps(directions(q), t, parts[d])):
                    far += g[row, code % g.shape[1]]
                    code = code // g.shape[1]
                low = np.minimum(low, far)
            out[d] = float(np.quantile(low, FOUND, method="higher"))
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products found for every query row among all other rows.

    Ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components, rows with a null id, and pairs of unequal length take no part. A row whose
    id is the query's is not its candidate; rows that repeat an id are candidates each, and
    a query id with several vectors has the best of all. Equal vectors are searched once. A
    query that finds fewer than k is searched in all cells, so fewer rows come back only
    where there are fewer candidates. Other columns are ignored; an empty table gives no rows.
    """
    v = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull() & F.exists(vec_col, lambda x: x != 0))
    v = v.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("is_query"))
    v = v.withColumns({f"h{i}": F.xxhash64(F.lit(i), "vec") for i in (1, 2)})
    # of equal vectors the k + 1 smallest ids can matter; the limit holds before the shuffle
    few = v.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    asked = stage(v.where("is_query").select("h1", "h2", "id").distinct(), "asked")
    reps = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec")).join(asked.select("h1", "h2").distinct().withColumn("is_query", F.lit(True)), ["h1", "h2"], "left")
    reps = reps.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "ids", F.col("ids")[0].alias("first"), F.coalesce("is_query", F.lit(False)).alias("is_query"), "vec")
    kind = vectors.schema[vec_col].dataType.simpleString()
    reps = stage(reps.mapInArrow(_norms, f"rep long, h1 long, h2 long, ids array<bigint>, first long, is_query boolean, vec {kind}, dim long, norm double, band long"), "reps")
    bands = reps.groupBy("dim", "band").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect()  # few: powers of two by dimension
    most, count = {(r["dim"], r["band"]): r["most"] for r in bands}, {}
    for r in bands:
        count[r["dim"]] = count.get(r["dim"], 0) + r["n"]
    parts = {d: max(1, int(math.log(max(n / CELL, 1)) / math.log(2 * width(d)))) for d, n in count.items()}
    span = {d: max(1, (2 * width(d)) ** parts[d] // max(1, -(-n // GROUP))) for d, n in count.items()}
    names, ids = ["query_id", "rank", id_col, "score"], reps.select(F.col("rep").alias("x"), "ids")
    if not count:
        return reps.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), "norm").toDF(*names)
    hashed = stage(reps.drop("ids", "h1", "h2", "norm").mapInArrow(_hash(parts, most), f"rep long, first long, is_query boolean, vec {kind}, dim long, band long, cells array<bigint>"), "cells")
    queries, total = hashed.where("is_query"), sum(count.values())

    def ranked(wide: dict[int, float], q: DataFrame) -> DataFrame:
        found = _search(hashed, q, parts, wide, span, total, k + 1).groupBy("q", "x", "f").agg(F.max("s").alias("s"))
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "f", "x"))).where(F.col("n") <= k + 1)
        rows = found.join(ids, "x").select("q", "s", F.explode("ids").alias("id"))
        return stage(rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("n") <= k + 1), "found")

    found = ranked(_width_needed(reps, parts, most, k), queries)
    short = stage(found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") <= k).select(F.col("q").alias("rep")), "short")
    if short.limit(1).count():
        every = ranked({d: math.inf for d in parts}, queries.join(short, "rep", "left_semi"))
        found = found.join(short.withColumnRenamed("rep", "q"), "q", "left_anti").unionByName(every)
    out = asked.join(reps.where("is_query").select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"]).select(F.col("id").alias("query_id"), "q")
    out = out.join(found.withColumnRenamed("id", id_col), "q").where(F.col("query_id") != F.col(id_col))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), id_col))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), id_col, F.col("s").alias("score"))
