"""Exact cosine near-duplicates by dual traversal of cover trees.

Vectors of one label are scaled to length 1, where cosine >= c means distance <=
sqrt(2 - 2c). Equal vectors form one class. A tree of nodes covers each label: a node of
many classes is split by a net of at most half its radius, taken from a bounded sample
of its classes, and each class goes to the nearest centre; children's covering radii are
measured. Level by level, pairs of nodes are judged by their centres' distance and their
radii: too far apart, they are dropped; near enough for all their pairs to link, they
are accepted whole; all others are split further. Only nodes of undecided pairs are split.
A node that splits leave nearly as large and as wide again and again (many vectors about
equally far from each other and nearer to one in their midst) is not split any more, so
rounds grow with logarithms of its size and radius.

Nodes that are small enough, or not split any more, become chunks. Undecided pairs of
chunks meet in tiles of bounded size, where each chunk becomes a cover tree of halving
radii and pairs of its nodes are judged the same way, down to dot products; where more
pairs would have to be met than pays, all rows of the two nodes above are compared.

Counts of links are summed by class, so neither copies nor pairs of a dense group are
listed: of the links a spanning forest is kept, which gives the components. Vectors too
scattered for any radius to tell apart leave all pairs of chunks undecided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import chance, connected_components, join_hot, stage

#: Classes of a chunk; sampled classes of a node and most children; classes of a leaf; chunks of a tile's side; slack of the bounds.
CHUNK, SAMPLE, FAN, LEAF, SIDE, SLACK = 1024, 512, 32, 8, 4, 1e-9
#: Distances nearer to the threshold than this are decided by dot products alone.
CLOSE = 1e-7
#: A child of more than this share of its node's classes and of its radius is no progress; splits without progress before a node is left as it is.
SHRINK, PATIENCE = 0.75, 3
#: Dot products that take no longer than one step of a traversal.
STEP = 8192


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def _greedy_net(d: np.ndarray, rows: np.ndarray, radius: float, most: int | None = None) -> list[np.ndarray]:
    """Rows by centre: each centre, the first of its part, takes what lies within ``radius`` of it; centres lie further apart."""
    parts, left = [], rows
    while len(left) and (most is None or len(parts) < most):
        near = d[left[0], left] <= radius
        near[0] = True
        parts.append(left[near])
        left = left[~near]
    return parts + [left] * (len(left) > 0)


class CoverTree:
    """Nested levels: a node covers its rows within its radius and is split by a net of half its level's radius."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.rows: list[np.ndarray] = []
        self.radius: list[float] = []
        self.kids: list[list[int]] = []
        if len(x):
            self._d = _apart(x, x)
            self._build(np.arange(len(x)), 2.0)
            del self._d

    def _build(self, rows: np.ndarray, scale: float) -> int:
        me, radius = len(self.rows), float(self._d[rows[0], rows].max()) + SLACK
        self.rows.append(rows)
        self.radius.append(radius)
        self.kids.append([])
        if len(rows) <= LEAF or radius <= 4 * SLACK:
            return me
        while scale / 2 >= radius:
            scale /= 2
        for part in _greedy_net(self._d, rows, scale / 2):
            self.kids[me].append(self._build(part, scale / 2))
        return me


def dual_traversal(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weight of links of each row of both trees, and edges that connect what the links connect."""
    na, nb, edges = np.zeros(len(wa), np.int64), np.zeros(len(wb), np.int64), []
    if not a.rows or not b.rows:
        return na, nb, edges
    far = np.sqrt(max(0.0, 2 - 2 * cosine))

    def compare(ra: np.ndarray, rb: np.ndarray, whole: bool) -> None:
        m = a.x[ra] @ b.x[rb].T >= cosine
        if whole:
            np.fill_diagonal(m, False)
            na[ra] += m @ wa[ra]
        else:
            na[ra] += m @ wb[rb]
            nb[rb] += m.T @ wa[ra]
        if m.any():
            edges.extend(_forest(m, ra, rb, whole))

    def accept(ra: np.ndarray, rb: np.ndarray, whole: bool) -> None:
        if whole:
            na[ra] += wa[ra].sum() - wa[ra]
            edges.extend((int(ra[0]), int(x)) for x in ra[1:])
        else:
            na[ra] += wb[rb].sum()
            nb[rb] += wa[ra].sum()
            edges.extend([(int(ra[0]), int(x)) for x in rb] + [(int(x), int(rb[0])) for x in ra[1:]])

    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        whole = same and i == j
        if not a.kids[i] and not b.kids[j]:
            compare(a.rows[i], b.rows[j], whole)
            continue
        ka, kb = np.array(a.kids[i] or [i]), np.array(b.kids[j] or [j])
        # kids of one row each are compared at once
        ones = [np.array([len(t.rows[k]) == 1 for k in ks]) for t, ks in ((a, ka), (b, kb))]
        single = ones[0].sum() > 1 and ones[1].sum() > 1
        d = _apart(a.x[[a.rows[k][0] for k in ka]], b.x[[b.rows[k][0] for k in kb]])
        reach = np.array([a.radius[k] for k in ka])[:, None] + np.array([b.radius[k] for k in kb])[None, :]
        live = d <= far + reach + SLACK
        if single:
            live &= ~(ones[0][:, None] & ones[1][None, :])
        if whole:
            live &= np.triu(np.ones(live.shape, bool))
        inside = live & (d + reach < far - CLOSE)
        if live.sum() * STEP >= len(a.rows[i]) * len(b.rows[j]):
            compare(a.rows[i], b.rows[j], whole)
            continue
        if single:
            compare(np.concatenate([a.rows[k] for k in ka[ones[0]]]), np.concatenate([b.rows[k] for k in kb[ones[1]]]), whole)
        for p, q in np.argwhere(live).tolist():
            if inside[p, q]:
                accept(a.rows[ka[p]], b.rows[kb[q]], whole and p == q)
            else:
                todo.append((int(ka[p]), int(kb[q])))
    return na, nb, edges


def _forest(m: np.ndarray, ra: np.ndarray, rb: np.ndarray, whole: bool) -> list[tuple[int, int]]:
    """Edges that connect what the links connect; ``whole``: rows and columns are the same vectors."""
    todo_a = m.any(1)
    todo_b = todo_a if whole else m.any(0)
    out = []
    for root in np.flatnonzero(todo_a).tolist():
        if not todo_a[root]:
            continue
        todo_a[root], stack = False, [(root, True)]
        while stack:
            x, row = stack.pop()
            todo = todo_b if row else todo_a
            new = np.flatnonzero((m[x] if row else m[:, x]) & todo)
            todo[new] = False
            out += [(int(ra[x]), int(rb[y])) if row else (int(ra[y]), int(rb[x])) for y in new.tolist()]
            stack += [(y, whole or not row) for y in new.tolist()]
    return out


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1))[:, None]


def _vectors(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres of each node's children: of the halving radii below the sample's own, the smallest whose net is small enough; if none is, the net's first centres."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        label, dim, node, n = now
        x, most = _unit(np.array(held, np.float64)), max(2, min(FAN, 2 * -(-n // CHUNK)))
        d, every = _apart(x, x), np.arange(len(x))
        r, best = float(d[0].max()), [every]
        while r > 4 * SLACK:
            net = _greedy_net(d, every, r / 2, most)
            if len(net) > most:
                best = net[:most] if len(best) == 1 else best
                break
            best, r = net, r / 2
        c = x[[part[0] for part in best]]
        return pa.RecordBatch.from_arrays([pa.array([label]), pa.array([dim]), pa.array([node]), pa.array([n]), pa.array([c.tobytes()], pa.binary())], names=["label", "dim", "node", "n", "centres"])

    for batch in batches:
        for *key, vec in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if tuple(key) != now:
                if held:
                    yield done()
                now, held = tuple(key), []
            held.append(vec)
    if held:
        yield done()


_MOVED = "label long, dim long, node string, key long, vec array<{0}>, w long, radius double, centre array<double>, flat boolean"


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part of a node stand together, its children's centres first; each class with its child, and each child's radius in this part."""
    now, centres, tops = None, None, None

    def rest(kind: pa.DataType) -> pa.RecordBatch:
        label, dim, node, _ = now
        at = np.flatnonzero(tops >= 0)
        n = len(at)
        cols = [pa.array([label] * n, pa.int64()), pa.array([dim] * n, pa.int64()), pa.array([f"{node}{c:02d}." for c in at.tolist()], pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(tops[at] + SLACK), pa.array(centres[at].tolist(), pa.list_(pa.float64())), pa.array([len(centres) == 1] * n)]
        return pa.RecordBatch.from_arrays(cols, names=_NAMES)

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        kind = batch.column("vec").type
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            part = batch.slice(s, e - s)
            if keys[s] != now:
                if now is not None:
                    yield rest(kind)
                now, dim = keys[s], keys[s][1]
                centres = np.frombuffer(part.column("centres")[0].as_py(), np.float64).reshape(-1, dim)
                tops = np.full(len(centres), -1.0)
                part = part.slice(1)
            if not part.num_rows:
                continue
            d = _apart(_unit(_vectors(part.column("vec"))), centres)
            near = d.argmin(1)
            np.maximum.at(tops, near, d[np.arange(len(d)), near])
            n, (_, _, node, _) = part.num_rows, now
            names = np.array([f"{node}{c:02d}." for c in range(len(centres))], object)
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(names[near], pa.string()), part.column("key"), part.column("vec"), part.column("w"), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.bool_())], names=_NAMES)
    if now is not None:
        yield rest(kind)


_NAMES = ["label", "dim", "node", "key", "vec", "w", "radius", "centre", "flat"]
_AT = ["label", "dim", "node"]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk, whose rows stand together: vectors, classes and weights."""
    now, rows = None, []
    names = ["label", "dim", "node", "part", "vecs", "ids", "weights"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def done(narrow: bool) -> pa.RecordBatch:
        vecs = np.array([r[1] for r in rows], np.float32 if narrow else np.float64)
        cols = [*now, vecs.tobytes(), np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[2] for r in rows], np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        narrow = pa.types.is_float32(batch.column(5).type.value_type)
        for *key, cid, vec, w in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if tuple(key) != now:
                if rows:
                    yield done(narrow)
                now, rows = tuple(key), []
            rows.append((cid, vec, w))
    if rows:
        yield done(narrow)


def _compare(cosine: float):
    """Rows of a tile stand together: pairs of chunk numbers (kind 0), then the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, chunks = None, [], {}

        def done() -> pa.RecordBatch:
            rows, trees = [], {i: CoverTree(x) for i, (x, _, _) in chunks.items()}
            for i, j in pairs:
                (_, ia, wa), (_, ib, wb) = chunks[i], chunks[j]
                na, nb, edges = dual_traversal(trees[i], trees[j], wa, wb, cosine, i == j)
                for ids, n in ((ia, na), (ib, nb)):
                    rows += [(int(ids[k]), int(n[k]), None) for k in np.flatnonzero(n).tolist()]
                rows += [(int(ia[p]), None, int(ib[q])) for p, q in edges]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "n", "b"])

        for batch in batches:
            for label, dim, ta, tb, kind, no, no2, vecs, ids, weights in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if (label, dim, ta, tb) != now:
                    if pairs:
                        yield done()
                    now, pairs, chunks = (label, dim, ta, tb), [], {}
                if kind == 0:
                    pairs.append((no, no2))
                else:
                    i, w = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
                    x = np.frombuffer(vecs, f"<f{len(vecs) // (len(i) * dim)}").astype(np.float64).reshape(len(i), -1)
                    chunks[no] = (_unit(x), i, w)
        if pairs:
            yield done()

    return run


def _of_nodes(pairs: DataFrame, side: Callable[[str], DataFrame]) -> DataFrame:
    """Pairs (label, dim, a, b) with what ``side`` has of a and of b. A pair is a byte or so on disk and 160 in a broadcast table, so Spark must not broadcast pairs for their files' size."""
    return pairs.hint("merge").join(side("a"), ["label", "dim", "a"]).hint("merge").join(side("b"), ["label", "dim", "b"])


def _levels(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Split nodes until all pairs are decided or between nodes of at most CHUNK classes.

    Returns all nodes, the classes by node, the undecided pairs of nodes (a, b), and
    edges between classes of pairs accepted whole. Nodes carry ``acc``, the weight of
    what their classes link with by such pairs, ``own``, whether a node's own weight is
    in it, and ``anchor``, a class that all of them link with.
    """
    far = float(np.sqrt(2 - 2 * cosine))
    kind = dict(classes.dtypes)["vec"][6:-1]
    members = classes.select("label", "dim", F.lit("").alias("node"), "key", "vec", "w")
    stats = (F.count("*").alias("n"), F.sum("w").alias("wsum"), F.min("key").alias("rep"))
    cur = members.groupBy(_AT).agg(*stats).withColumns({"centre": F.lit(None).cast("array<double>"), "radius": F.lit(4.0), "flat": F.lit(False), "acc": F.lit(0).cast("long"), "own": F.lit(False), "anchor": F.lit(None).cast("long"), "stuck": F.lit(0)})
    cur = stage(cur, "nodes")
    pairs = stage(cur.select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b")), "pairs")
    settled, edges, rounds = [], [], 0
    while True:
        active = pairs.select("label", "dim", F.col("a").alias("node")).union(pairs.select("label", "dim", "b")).distinct()
        wide = stage(cur.where((F.col("n") > CHUNK) & ~F.col("flat")).join(active, _AT, "left_semi").select(*_AT, "n"), "open")
        if not wide.limit(1).count():
            break
        mine = members.join(wide, _AT)
        rounds += 1
        sample = mine.where(chance(F.lit(rounds), "key") * F.col("n") <= float(SAMPLE))
        centres = stage(sample.select(*_AT, "n", "vec").repartition(*_AT).sortWithinPartitions(*_AT).mapInArrow(_split, "label long, dim long, node string, n long, centres binary"), "centres")
        # a node's classes are dealt to tasks of some thousand, each with the node's centres first
        parts = F.ceil(F.col("n") / (2 * CHUNK))
        none = lambda k: F.lit(None).cast(k)
        heads = centres.select(*_AT, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), none("long").alias("key"), none(f"array<{kind}>").alias("vec"), none("long").alias("w"), "centres")
        rows = mine.join(centres.select(*_AT), _AT, "left_semi").select(*_AT, F.pmod(F.xxhash64(F.lit(-1), "key"), parts).alias("part"), F.lit(1).alias("kind"), "key", "vec", "w", none("binary").alias("centres"))
        sent = heads.unionByName(rows).repartition(*_AT, "part").sortWithinPartitions(*_AT, "part", "kind")
        moved = stage(sent.mapInArrow(_move, _MOVED.format(kind)), "moved")
        settled.append(members.join(centres.select(*_AT), _AT, "left_anti"))
        members = moved.where("key IS NOT NULL").select(*_AT, "key", "vec", "w")
        kids = members.groupBy(_AT).agg(*stats).join(moved.where("key IS NULL").groupBy(_AT).agg(F.max("radius").alias("radius"), F.first("centre").alias("centre"), F.first("flat").alias("flat")), _AT)
        up = cur.select("label", "dim", F.col("node").alias("parent"), "acc", "own", "anchor", *[F.col(c).alias(f"{c}_up") for c in ("n", "radius", "stuck")])
        kids = kids.withColumn("parent", F.expr("substring(node, 1, length(node) - 3)")).join(up, ["label", "dim", "parent"])
        large = (F.col("n") > SHRINK * F.col("n_up")) & (F.col("radius") > SHRINK * F.col("radius_up"))
        kids = kids.withColumn("stuck", F.when(large, F.col("stuck_up") + 1).otherwise(0)).withColumn("flat", F.col("flat") | (F.col("stuck") >= PATIENCE)).drop("n_up", "radius_up", "stuck_up")
        still = cur.join(centres.select(*_AT), _AT, "left_anti")
        step = stage(kids.unionByName(still.withColumn("parent", F.col("node"))), "step")
        side = lambda s: step.select("label", "dim", F.col("parent").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "wsum", "rep", "centre", "radius")])
        met = _of_nodes(pairs, side).where("a <> b OR node_a <= node_b")
        dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        d, reach = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)), F.col("radius_a") + F.col("radius_b")
        one = F.col("node_a") == F.col("node_b")
        d = F.when(one, 0.0).otherwise(F.coalesce(d, F.lit(0.0)))  # an unsplit root has no centre, but a radius that excludes nothing
        met = met.withColumn("d", d).withColumn("reach", reach).where(F.col("d") <= F.col("reach") + far + SLACK)
        met = stage(met.select("label", "dim", "node_a", "node_b", "wsum_a", "wsum_b", "rep_a", "rep_b", (F.col("d") + F.col("reach") < far - CLOSE).alias("sure")), "judged")
        sure = met.where("sure")
        edges.append(sure.where(~one).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        gain = sure.select("label", "dim", F.col("node_a").alias("node"), F.col("wsum_b").alias("more"), one.alias("self"), F.col("rep_b").alias("at"))
        gain = gain.unionByName(sure.where(~one).select("label", "dim", F.col("node_b").alias("node"), F.col("wsum_a").alias("more"), F.lit(False).alias("self"), F.col("rep_a").alias("at")))
        gain = gain.groupBy(_AT).agg(F.sum("more").alias("more"), F.bool_or("self").alias("self"), F.min("at").alias("at"))
        cur = step.drop("parent").join(gain, _AT, "left").withColumns({"acc": F.col("acc") + F.coalesce("more", F.lit(0)), "own": F.col("own") | F.coalesce("self", F.lit(False)), "anchor": F.coalesce("anchor", "at")}).drop("more", "self", "at")
        cur = stage(cur, "nodes")
        pairs = met.where("NOT sure").select("label", "dim", F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    for part in settled:
        members = members.unionByName(part.select(members.columns))
    return cur, members, pairs, edges


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows link when their labels are equal and not null, their lengths are equal and
    their cosine in double precision reaches ``cosine``. Vectors that are null, zero
    or hold null or non-finite components link with nothing, nor do rows with a null
    id, whose component is null. Repeated rows link like any two rows. Other columns are
    ignored; an empty table gives no rows.
    """
    given = dict(vectors.dtypes)[vec_col]
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if given == "array<float>" else "array<double>").alias("vec"), F.col(label_col).alias("label"))
    v = v.withColumn("key", F.when(usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.xxhash64("label", "vec")))
    v = v.withColumn("key2", F.xxhash64(F.lit(1), "vec", "label"))
    classes = v.where("key IS NOT NULL").groupBy("key", "key2").agg(F.min("id").alias("cid"), F.count("*").alias("w"), F.first("vec").alias("vec"), F.first("label").alias("lab"))
    classes = stage(classes.select("key", "key2", "cid", "w", "vec", F.xxhash64("lab").alias("label"), F.size("vec").cast("long").alias("dim")), "classes")
    # two vectors of one hash: one pair is expected among 6e9 vectors; they are named by the second hash
    shared = [r["key"] for r in classes.groupBy("key").count().where("count > 1").select("key").collect()]
    name = F.when(F.col("key").isin(shared), F.col("key2")).otherwise(F.col("key")) if shared else F.col("key")
    classes, v = classes.withColumn("key", name), v.withColumn("key", name)
    nodes, members, pairs, edges = _levels(classes, cosine)
    inner = pairs.select("label", "dim", F.col("a").alias("node")).union(pairs.select("label", "dim", "b")).distinct().join(nodes.select(*_AT, F.ceil(F.col("n") / CHUNK).alias("parts")), _AT)
    dealt = members.join(stage(inner, "leaves"), _AT).withColumn("part", F.pmod(F.xxhash64(F.lit(-2), "key"), F.col("parts")))
    dealt = dealt.select(*_AT, "part", "key", "vec", "w").repartition(*_AT, "part").sortWithinPartitions(*_AT, "part", "key")
    chunks = stage(dealt.mapInArrow(_chunks, "label long, dim long, node string, part long, vecs binary, ids binary, weights binary"), "chunks")
    no = F.row_number().over(Window.partitionBy("label", "dim").orderBy("node", "part")) - 1
    numbers = stage(chunks.select(*_AT, "part", no.cast("long").alias("no")), "numbers")
    side = lambda s: numbers.select("label", "dim", F.col("node").alias(s), F.col("no").alias(f"no_{s}"))
    meet = _of_nodes(pairs, side).where("a <> b OR no_a <= no_b")
    lo, hi = F.least("no_a", "no_b"), F.greatest("no_a", "no_b")
    tile = ["label", "dim", "ta", "tb"]
    meet = stage(meet.select("label", "dim", F.floor(lo / SIDE).alias("ta"), F.floor(hi / SIDE).alias("tb"), lo.alias("no"), hi.alias("no2")), "meet")
    need = meet.select(*tile, "no").union(meet.select(*tile, "no2")).distinct()
    body = chunks.join(numbers, [*_AT, "part"]).select("label", "dim", "no", "vecs", "ids", "weights")
    null = F.lit(None).cast("binary")
    rows = meet.select(*tile, F.lit(0).alias("kind"), "no", "no2", null.alias("vecs"), null.alias("ids"), null.alias("weights"))
    rows = rows.unionByName(need.join(body, ["label", "dim", "no"]).select(*tile, F.lit(1).alias("kind"), "no", F.lit(None).cast("long").alias("no2"), "vecs", "ids", "weights"))
    found = stage(rows.repartition(*tile).sortWithinPartitions(*tile, "kind").mapInArrow(_compare(cosine), "a long, n long, b long"), "links")
    # a node may hold a third of all classes
    here = members.select(F.struct(*_AT).alias("at"), "key", "w")
    here = stage(join_hot(here, nodes.select(F.struct(*_AT).alias("at"), "acc", "own", "anchor"), "at").select("key", (F.col("acc") - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("acc"), "anchor"), "accepted")
    links = found.where("n IS NOT NULL").select(F.col("a").alias("key"), "n").unionByName(here.where("acc > 0").select("key", F.col("acc").alias("n"))).groupBy("key").agg(F.sum("n").alias("n"))
    joined = found.where("b IS NOT NULL").select("a", "b").unionByName(here.where("anchor IS NOT NULL").select(F.col("key").alias("a"), F.col("anchor").alias("b")))
    for e in edges:
        joined = joined.unionByName(e)
    comp = connected_components(joined).withColumnRenamed("node", "key")
    known = classes.select("key", "cid", "w").join(links, "key", "left").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    known = stage(known.select("key", "cid", "comp", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n")), "known")
    least = stage(known.groupBy("comp").agg(F.min("cid").alias("component_id")), "least")
    known = stage(join_hot(known, least, "comp").select("key", "n", "component_id"), "components")
    out = v.select("id", "key").join(known, "key", "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept"))
