"""Exact top-k by inner product with block-at-a-time pruning.

Candidates stand in one order (their two leading components, then a hash), and blocks
are ranges of it: a block's forward index is the matrix of its vectors' integer
components, its summary the largest and smallest value of each component. A query's bound on a block is the sum over components of the larger of
query value times maximum and query value times minimum; no vector of the block
scores more. For each pack of queries a task takes the blocks of its share in order
of their bounds and scores each through its forward index until the next bound falls
below the k-th score so far. Shares start from the k-th score that a first round
over each query's best blocks has found, get only blocks that some query's bound may
still let in, and their results merge by a top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import stage, tasks

#: Vectors of a block, queries of a pack, blocks of a share and packs of a group (they meet in one task), blocks of the first round.
BLOCK, PACK, SHARE, PACKS, FIRST = 256, 256, 32, 32, 2
SCALE = 1024
#: Leads are numbered in so many buckets.
BUCKETS = 4096


def usable(vec: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _small(m: np.ndarray) -> bytes:
    """Integers in as few bytes each as they need."""
    top = max(int(m.max()), -int(m.min()) - 1) if m.size else 0
    return m.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // max(rows * dim, 1) or 8}").astype(np.int64).reshape(rows, dim)


def _pack(group: str):
    """One row for each run of equal group numbers: ids, copies, matrix, and the components' extremes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, copies, vecs = None, [], [], []

        def row() -> pa.RecordBatch:
            m = np.array(vecs, np.int64).reshape(len(vecs), now[1])
            cols = [[now[0]], [now[1]], [np.array(ids, np.int64).tobytes()], [np.array(copies, np.int64).tobytes()], [_small(m)], [_small(m.max(0))], [_small(m.min(0))]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.binary()] * 5, strict=True)], names=[group, "dim", "ids", "copies", "vecs", "hi", "lo"])

        for batch in batches:
            for g, d, i, w, v in zip(*(batch.column(x).to_pylist() for x in range(5)), strict=True):
                if (g, d) != now:
                    if ids:
                        yield row()
                    now, ids, copies, vecs = (g, d), [], [], []
                ids.append(i)
                copies.append(w)
                vecs.append(v)
        if ids:
            yield row()

    return run


def pack(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Pack (id, copies, vec, lead) into rows of about ``rows`` vectors of one dimension: ranges of the order (lead, hash).

    A vector's place is its lead's first place plus the hash's share of the lead's count,
    so a range holds about ``rows`` vectors however many share a lead.
    """
    v = vectors.select("id", "copies", "vec", F.size("vec").cast("long").alias("dim"), "lead")
    leads = stage(v.groupBy("lead").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod("lead", F.lit(BUCKETS))), "leads")
    n = leads.agg(F.sum("n").alias("n")).first()["n"] or 0
    # running sums in two steps: over the fixed number of buckets, and within each
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = leads.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", before(Window.orderBy("bucket")).alias("base"))
    leads = stage(leads.join(base, "bucket").select("lead", "n", (F.col("base") + before(Window.partitionBy("bucket").orderBy("lead"))).alias("first")), "places")
    share = F.shiftrightunsigned(F.xxhash64("id", "vec"), 32) / F.lit(float(1 << 32))
    v = v.join(leads, "lead").withColumn(name, F.floor((F.col("first") + share * F.col("n")) / rows))
    v = v.select(name, "dim", "id", "copies", "vec").repartition(tasks(v.sparkSession, n, 64 * rows, rows), name, "dim").sortWithinPartitions(name, "dim", "id")
    return stage(v.mapInArrow(_pack(name), f"{name} long, dim long, ids binary, copies binary, vecs binary, hi binary, lo binary"), name)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers, by floating point where that is exact and fast."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Summed maxima of (queries x blocks); exact in integers."""
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    return products(pos, hi) + products(neg, lo)


def _merge(best: dict, qid: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    s, i = best.get(qid, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    keep = ids != qid
    s, i = np.concatenate([s, scores[keep]]), np.concatenate([i, ids[keep]])
    o = np.lexsort((i, -s))[:k]
    best[qid] = (s[o], i[o])


def search_share(qids: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list[tuple], k: int) -> tuple[dict, int]:
    """Best k of each query among the blocks (ids, matrix, maxima, minima, number, copies), and the number of blocks scored.

    ``floor``: a score that the query's k-th is known to reach. A block is scored for
    the queries whose bound is at least the score they must reach (ties can still win
    by the smaller id).
    """
    best: dict[int, tuple] = {}
    b = bounds(q, np.stack([x[2] for x in blocks]), np.stack([x[3] for x in blocks]))
    order, scored = np.argsort(-b, axis=1, kind="stable"), 0
    need = floor.copy()
    for step in range(len(blocks)):
        at = order[:, step]
        live = b[np.arange(len(q)), at] >= need
        if not live.any():
            break  # bounds fall along the order
        for j in np.unique(at[live]):
            rows = np.flatnonzero(live & (at == j))
            ids, m, copies = blocks[j][0], blocks[j][1], blocks[j][5]
            s = products(q[rows], m)
            scored += len(rows)
            for r, x in zip(rows.tolist(), s, strict=True):
                ok = x >= need[r]
                if ok.any():
                    _merge(best, int(qids[r]), np.repeat(x[ok], copies[ok]), np.repeat(ids[ok], copies[ok]), k)
                    got = best[int(qids[r])][0]
                    if len(got) == k:
                        need[r] = max(need[r], got[-1])
    return best, scored


_OUT = "query_id long, vec_id long, score long"
_PAIR = ["grp", "share", "dim", "kind", "no", "ids", "copies", "vecs", "hi", "lo"]
LOWEST = -(2**62)


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _floors(raw: bytes | None, n: int) -> np.ndarray:
    return np.full(n, LOWEST, np.int64) if raw is None else np.frombuffer(raw, np.int64)


def _rank_blocks(packs: list[tuple], blocks: list[tuple]) -> pa.RecordBatch:
    """The blocks that are among the FIRST by bound for some query of a pack."""
    hi, lo, rows = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]), []
    for no, dim, _, _, q, _ in packs:
        b = bounds(q, hi, lo)
        used = np.unique(np.argsort(-b, axis=1, kind="stable")[:, :FIRST])
        rows += [(no, dim, blocks[j][4], int(b[:, j].max())) for j in used]
    return _batch(["pack", "dim", "block", "bound"], [pa.int64()] * 4, rows)


def _raise_floors(k: int):
    def run(packs: list[tuple], blocks: list[tuple]) -> pa.RecordBatch:
        rows = []
        for no, dim, raw, qids, q, floor in packs:
            best, _ = search_share(qids, q, floor, blocks, k) if blocks else ({}, 0)
            low = [int(best[i][0][-1]) if i in best and len(best[i][0]) == k else LOWEST for i in qids.tolist()]
            rows.append((no, dim, *raw, np.array(low, np.int64).tobytes()))
        return _batch(["pack", "dim", "ids", "vecs", "floor"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)

    return run


def _score(k: int):
    def run(packs: list[tuple], blocks: list[tuple]) -> pa.RecordBatch:
        rows = []
        for _, _, _, qids, q, floor in packs:
            best, _ = search_share(qids, q, floor, blocks, k) if blocks else ({}, 0)
            rows += [(i, int(v), int(x)) for i, (sc, ids) in best.items() for v, x in zip(ids, sc, strict=True)]
        return _batch(["query_id", "vec_id", "score"], [pa.int64()] * 3, rows)

    return run


def _wanted_blocks(packs: list[tuple], blocks: list[tuple]) -> pa.RecordBatch:
    """The blocks whose bound reaches the floor of some query of the packs."""
    hi, lo, used = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]), np.zeros(len(blocks), bool)
    for *_, q, floor in packs:
        used |= (bounds(q, hi, lo) >= floor[:, None]).any(0)
    return _batch(["pack", "dim", "block"], [pa.int64()] * 3, [(packs[0][0], packs[0][1], blocks[j][4]) for j in np.flatnonzero(used).tolist()])


def _groups(on_group, need_blocks: bool = True):
    """Calls ``on_group(packs, blocks)`` for the rows of each (grp, share, dim); packs come before blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, blocks = None, [], []
        for batch in batches:
            for grp, share, dim, kind, no, ids, copies, vecs, hi, lo in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if (grp, share, dim) != now:
                    if packs and (blocks or not need_blocks):
                        yield on_group(packs, blocks)
                    now, packs, blocks = (grp, share, dim), [], []
                if kind == 0:
                    qids = np.frombuffer(ids, np.int64)
                    packs.append((no, dim, (ids, vecs), qids, _matrix(vecs, len(qids), dim), _floors(hi, len(qids))))
                else:
                    own = np.frombuffer(ids or b"", np.int64)
                    blocks.append((own, _matrix(vecs or b"", len(own), dim), _matrix(hi, 1, dim)[0], _matrix(lo, 1, dim)[0], no, np.frombuffer(copies or b"", np.int64)))
        if packs and (blocks or not need_blocks):
            yield on_group(packs, blocks)

    return run


def _meet(packs: DataFrame, blocks: DataFrame, on_group, schema: str, need_blocks: bool = True) -> DataFrame:
    rows = packs.withColumn("kind", F.lit(0)).select(_PAIR).unionByName(blocks.withColumn("kind", F.lit(1)).select(_PAIR))
    rows = rows.repartition("grp", "share", "dim").sortWithinPartitions("grp", "share", "dim", "kind", "no")
    return rows.mapInArrow(_groups(on_group, need_blocks), schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of every query row with all other rows.

    Components become floor(1024 * x); ties go to the smaller id; fewer rows if there
    are fewer candidates. Vectors that are null or hold null or non-finite components,
    rows with a null id, and pairs of unequal length take no part. A row whose id is the
    query's is not its candidate; rows that repeat an id are candidates each; a query id
    with several vectors has the best of all of them. Other columns are ignored; an empty
    table gives no rows.
    """
    v = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    v = v.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vec"), is_query.alias("is_query"))
    v = v.groupBy("id", "vec", "is_query").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))  # more than k copies change nothing
    # vectors whose largest components agree in place and sign stand together: tight extremes
    signs = F.transform("vec", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), (x > 0).alias("s")))
    lead = F.slice(F.transform(F.array_sort(signs), lambda t: F.concat(t["i"].cast("string"), t["s"].cast("string"))), 1, 2)
    v = stage(v.withColumn("lead", F.xxhash64(F.size("vec"), F.array_join(lead, ","))), "vectors")
    blocks = pack(v, BLOCK, "block")
    packs = pack(v.where("is_query"), PACK, "pack")
    top = blocks.agg(F.max("block").alias("b")).first()["b"]
    last = packs.agg(F.max("pack").alias("p")).first()["p"]
    spread = lambda df, col, n: df.withColumn(col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(n)).cast("long"))))
    shares, groups = (top or 0) // SHARE, (last or 0) // PACKS
    none = F.lit(None).cast("binary")
    b = blocks.withColumn("no", F.col("block")).withColumn("share", F.floor(F.col("block") / SHARE))
    sums = spread(b.withColumns({c: none for c in ("ids", "copies", "vecs")}), "grp", groups)  # summaries meet all queries
    q = packs.select(F.col("pack").alias("no"), "dim", "ids", "copies", "vecs", none.alias("hi"), none.alias("lo")).withColumn("grp", F.floor(F.col("no") / PACKS))
    # first round: each query's best FIRST blocks by bound give its floor
    ranked = _meet(spread(q, "share", shares), sums, _rank_blocks, "pack long, dim long, block long, bound long")
    best = F.row_number().over(Window.partitionBy("pack", "dim").orderBy(F.desc("bound"), "block"))
    starts = ranked.withColumn("n", best).where(F.col("n") <= 4 * FIRST).select(F.col("pack").alias("grp"), "dim", "block")
    seeds = b.drop("share").join(starts, ["block", "dim"]).withColumn("share", F.lit(0).cast("long"))
    floored = _meet(q.withColumn("grp", F.col("no")).withColumn("share", F.lit(0).cast("long")), seeds, _raise_floors(k), "pack long, dim long, ids binary, vecs binary, floor binary", False)
    q = stage(floored, "floors").select(F.col("pack").alias("no"), "dim", "ids", none.alias("copies"), "vecs", F.col("floor").alias("hi"), none.alias("lo")).withColumn("grp", F.floor(F.col("no") / PACKS))
    wanted = stage(_meet(spread(q, "share", shares), sums, _wanted_blocks, "pack long, dim long, block long").select(F.floor(F.col("pack") / PACKS).alias("grp"), F.floor(F.col("block") / SHARE).alias("share"), "dim", "block"), "wanted")
    qs = q.join(wanted.select("grp", "share", "dim").distinct(), ["grp", "dim"])
    found = _meet(qs, b.drop("share").join(wanted, ["block", "dim"]), _score(k), _OUT)
    order_by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
