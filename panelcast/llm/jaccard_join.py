"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two texts link when ``den * |A & B| >= num * |A | B|`` for their sets of distinct
``k``-word shingles. All sets are sorted by one global order (rare first). A set
of size n and a partner at or above the threshold share at least m shingles
within their m-prefixes, the first ``n - ceil(num * n / den) + m`` shingles. Each
text picks its m (``ell``) by estimated cost: the postings that the longer prefix
adds against the candidates that need m hits. A pair becomes a candidate with
``min(ell, ell')`` common prefix shingles, if these and the rest of the sets can
still reach the threshold.

Steps: (1) one pass gives each text's set size and signature (texts with equal
sets form one class) and counts of shingles that repeat within a task, which give
the order; (2) a second pass finds the shingles that many prefixes hold, which move
back in the order, and a third gives each class's prefix; (3) postings with one class
go, short posting lists give pairs, each counted; members of long lists go to the
list's hub (its smallest class), so that no list is multiplied out; (4) the sets of a
hub's group meet in a tile, one product of incidence matrices. In a group too large for
that, members are first compared with the hub alone, in parts of bounded size; those
that do not link with it may still link with another member, so they are compared with
all, in tiles of bounded size; (5) connected components. The order only affects speed,
never the result.

A class is named by a 64-bit signature; where two sets share one, which a second
signature tells, these classes are named by the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.shingles import mix, pieces, shingle_sets, text_buffers
from panelcast.llm.util import connected_components, filter_bits, filter_flags, filter_slot, fresh, in_filter, join_hot, release_memory, stage

#: Most bits of a bucket of frequent shingles (a byte each in every task), shingles of a bucket, and the least count kept.
MOST_BITS, PER_BUCKET, LEAST = 24, 16, 6
#: Posting lists up to this many classes give pairs; longer ones go to hubs.
SHORT = 16
#: Most classes and shingles of a block of a group, and most prefix matches asked for.
BLOCK, BLOCK_SHINGLES, MOST_ELL = 1024, 1_000_000, 16
#: Cost of one verification in postings, for each 100 shingles.
VERIFY = 4.0
_U = np.uint64


def _signatures(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from sums over its members; 0 for the empty set."""
    with np.errstate(over="ignore"):
        a, at, end = mix(sets + _U(0x5851F42D4C957F2D)), np.cumsum(sizes) - sizes, np.zeros(1, _U)
        s = np.add.reduceat(np.concatenate([a, end]), at)  # empty sets at the end start at the extra 0
        x = np.bitwise_xor.reduceat(np.concatenate([mix(a), end]), at)
        n = sizes.astype(_U)
        one, two = mix(s ^ mix(x + n)), mix(x ^ mix(s * _U(3) + n))
        return tuple(np.where(sizes > 0, h, _U(0)).view(np.int64) for h in (one, two))


def _nodes(sets: np.ndarray, sizes: np.ndarray, shared: list[int]) -> np.ndarray:
    """Names of classes; ``shared``: signatures of several sets."""
    one, two = _signatures(sets, sizes)
    return np.where(np.isin(one, shared), two, one) if shared else one


def _profile(k: int, names: list[str]):
    """Rows (carried columns, n, sig, sig2) of texts, and rows (bucket, cnt) of shingles that repeat within a task."""
    carried = len(names) - 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kinds = [], 0, []

        def counts() -> pa.RecordBatch:
            h = np.concatenate(held)
            h.sort()
            st = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            c = np.diff(np.append(st, len(h)))
            b, c = (h[st][c > 1] >> _U(64 - MOST_BITS)).astype(np.int64), c[c > 1]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(b), t) for t in kinds], *[pa.nulls(len(b), pa.int64())] * 3, pa.array(b), pa.array(c)], names=names)

        for batch in batches:
            kinds = [batch.column(x).type for x in range(carried)]
            data, offs = text_buffers(batch.column(carried))
            for i, j in pieces(offs):
                sets, sizes = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                none = pa.nulls(j - i, pa.int64())
                own = [batch.column(x).slice(i, j - i) for x in range(carried)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), *map(pa.array, _signatures(sets, sizes)), none, none], names=names)
                held.append(sets)
                n += len(sets)
                if n > 2_000_000:
                    yield counts()
                    held, n = [], 0
        if n:
            yield counts()
        held.clear()
        release_memory()

    return run


def _prefix_len(n: np.ndarray, ell: np.ndarray | int, num: int, den: int) -> np.ndarray:
    return np.minimum(n, n - -(-num * n // den) + ell)


def _prefixes(k: int, num: int, den: int, classes: np.ndarray, shared: list[int]):
    """classes: log2 of the estimated frequency of each bucket (0: rare)."""
    shift = _U(64 - (len(classes).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of this task: once is enough
        for batch in batches:
            data, offs = text_buffers(batch.column(0))
            for i, j in pieces(offs):
                sets, sizes = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                sig, ends = _nodes(sets, sizes, shared), np.cumsum(sizes)
                key = (sets >> _U(6)) | (classes[(sets >> shift).astype(np.int64)].astype(_U) << _U(58))
                toks, nodes, metas = [], [], []
                for s, n, e in zip(sig.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                    if not n or s in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(s)
                    own = np.sort(key[e - n : e])
                    need = -(-num * n // den)
                    ells = np.arange(1, min(MOST_ELL, need) + 1)
                    cost = np.cumsum(np.exp2((own >> _U(58)).astype(float)))[n - need + ells - 1]
                    ell = int(ells[np.argmin(cost + VERIFY * (1 + n / 100) * cost / ells)])
                    p = n - need + ell
                    toks.append(own[:p])
                    nodes.append(np.full(p, s))
                    metas.append(np.full(p, n * 128 + ell))
                if toks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (toks, nodes, metas)], names=["token", "node", "meta"])
        release_memory()

    return run


def _wanted_sets(k: int, bits: np.ndarray, shared: list[int]):
    """Sets of texts whose slot is in the filter; false hits only cost time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            part = batch.column(0).filter(pa.array(in_filter(bits, batch.column(1))))
            data, offs = text_buffers(part)
            for i, j in pieces(offs):
                sets, sizes = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                sig, ends = _nodes(sets, sizes, shared).tolist(), np.cumsum(sizes)
                rows = [(s, sets[e - n : e].tobytes()) for s, n, e in zip(sig, sizes.tolist(), ends.tolist(), strict=True) if n and s not in seen]
                if len(seen) < 200_000:
                    seen.update(s for s, _ in rows)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["node", "shingles"])

    return run


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``a`` with each of ``b``; exact on their 64-bit shingles."""
    na, nb = [len(s) for s in a], [len(s) for s in b]
    _, inv = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ca, cb = inv[: sum(na)], inv[sum(na) :]
    both = np.intersect1d(ca, cb)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    sides = []
    for c, r in ((ca, ra), (cb, rb)):
        at = np.searchsorted(both, c)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == c) if len(both) else np.zeros(len(c), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], r[hit][order]))
    out, wide = np.zeros((len(a), len(b)), np.float64), 1024
    for lo in range(0, len(both), wide):
        m = []
        for (c, r), n in zip(sides, (len(a), len(b)), strict=True):
            x = np.zeros((n, wide), np.float32)
            p, q = np.searchsorted(c, [lo, lo + wide])
            x[r[p:q], c[p:q] - lo] = 1
            used = np.unique(r[p:q])
            m.append((used, x[used]))
        out[np.ix_(m[0][0], m[1][0])] += m[0][1] @ m[1][1].T
    return out


def verify_tile(ia: np.ndarray, a: list[np.ndarray], ib: np.ndarray, b: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between two lists of sets, as many as connect what all links connect: a spanning forest. Members of both lists link with none of their own."""
    if len(ia) == 2 and len(ib) == 2 and (ia == ib).all():
        c = len(np.intersect1d(*a, assume_unique=True))
        return [(int(ia[0]), int(ia[1]))] if den * c >= num * (len(a[0]) + len(a[1]) - c) else []
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    common = common_counts(a, b)
    links = (den * common >= num * (na[:, None] + nb[None, :] - common)) & (ia[:, None] != ib[None, :])
    todo, out = [np.ones(len(ia), bool), np.ones(len(ib), bool)], []
    for root in np.flatnonzero(links.any(1)).tolist():
        if not todo[0][root]:
            continue
        todo[0][root], stack = False, [(0, root)]
        while stack:
            side, x = stack.pop()
            new = np.flatnonzero((links[:, x] if side else links[x]) & todo[1 - side])
            todo[1 - side][new] = False
            out += [(int(ia[y]), int(ib[x])) if side else (int(ia[x]), int(ib[y])) for y in new.tolist()]
            stack += [(1 - side, y) for y in new.tolist()]
    return out


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verify_hubs(num: int, den: int):
    """Rows (hub, part, node, shingles) stand together by part, the hub's own row (kind 0) first; links with the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, _U)
        for batch in batches:
            out = []
            for hub, kind, node, raw in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                x = np.frombuffer(raw, _U)
                if kind == 0:
                    own = x
                    continue
                small, large = (x, own) if len(x) < len(own) else (own, x)
                at = np.searchsorted(large, small)
                c = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if den * c >= num * (len(own) + len(x) - c):
                    out.append((hub, node))
            yield _pairs(out)

    return run


def _verify_tiles(num: int, den: int):
    """Rows (hub, i, j, side, node, shingles) of a tile stand together (side 2: on both sides); its links are found as it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, ({}, {}), []

        def done() -> None:
            if held[0] and held[1]:
                out.extend(verify_tile(*[y for h in held for y in (np.array(list(h)), [np.frombuffer(b, _U) for b in h.values()])], num, den))
            held[0].clear()
            held[1].clear()

        for batch in batches:
            for hub, i, j, side, node, b in zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True):
                if (hub, i, j) != now:
                    done()
                    now = (hub, i, j)
                for x in (0, 1) if side == 2 else (side,):
                    held[x][node] = b
            if len(out) > 10_000:
                yield _pairs(out)
                out.clear()
        done()
        yield _pairs(out)

    return run


def frequency_classes(counts: DataFrame, bits: int) -> np.ndarray:
    """log2 of the sum of ``cnt`` of each ``bucket`` (of MOST_BITS, cut to ``bits``), 0 below LEAST; at most 2**MOST_BITS bytes."""
    got = counts.groupBy(F.shiftright("bucket", MOST_BITS - bits).alias("bucket")).agg(F.sum("cnt").alias("c")).where(F.col("c") >= LEAST)
    got = got.select("bucket", F.floor(F.log2("c")).cast("tinyint").alias("c")).toPandas()
    out = np.zeros(1 << bits, np.uint8)
    out[got["bucket"].to_numpy(np.int64)] = got["c"].to_numpy(np.uint8)
    return out


def _log2(x: float, least: int, most: int) -> int:
    return max(least, min(most, int(np.log2(max(x, 1)))))


def linked_rows(docs: DataFrame, carry: list[str], text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(``carry``, n, node, comp) of every row of ``docs``: its set's size, its class and the component of that class.

    Rows of equal sets share a node; classes that links connect share a comp, the
    smallest node reached. Null or wordless texts have n = 0 and no comp. Repeated rows
    come out once each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = fresh("text", carry)
    d = docs.select(*carry, F.col(text_col).cast("string").alias(text))
    kinds = dict(d.dtypes)
    names = [*(f"c{i}" for i in range(len(carry))), "n", "sig", "sig2", "bucket", "cnt"]
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), *(f"{c} long" for c in names[-5:])])
    prof = stage(d.mapInArrow(_profile(k, names), schema), "profile")
    rows = prof.where("bucket IS NULL")
    both = rows.where("n > 0").groupBy("sig").agg(F.min("sig2").alias("lo"), F.max("sig2").alias("hi"), F.max("n").alias("n"))
    # two sets of one signature: one pair is expected among 6e9 sets
    shared = [r["sig"] for r in both.where("lo <> hi").select("sig").collect()]
    rows = rows.withColumn("node", F.when(F.col("sig").isin(shared), F.col("sig2")).otherwise(F.col("sig")) if shared else F.col("sig"))
    bits = _log2((rows.agg(F.sum("n").alias("n")).first()["n"] or 0) / PER_BUCKET, 18, MOST_BITS)
    table = frequency_classes(prof.where("bucket IS NOT NULL").select("bucket", "cnt"), bits)

    def postings(classes: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast(classes)
        return d.select(text).mapInArrow(lambda it: _prefixes(k, num, den, held.value, shared)(it), "token long, node long, meta long")

    # shingles found in many prefixes of a first order go back in the second
    often = postings(table).groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > SHORT // 2)
    often = often.select(F.shiftright(F.col("token").bitwiseAND((1 << 58) - 1), 58 - MOST_BITS).alias("bucket"), (F.col("m") * den / (den - num)).cast("long").alias("cnt"))
    posts = postings(np.maximum(table, frequency_classes(often, bits)))
    # one shuffle and sort by token gives each posting its list's hub and length; long lists spill
    w = Window.partitionBy("token")
    many = posts.withColumns({"hub": F.min("node").over(w), "top": F.max("node").over(w), "m": F.count("*").over(w)}).where("hub <> top").drop("top")
    many = stage(many.dropDuplicates(["token", "node"]), "postings")
    routes = stage(_short_pairs(many.where(F.col("m") <= SHORT), num, den).withColumn("long", F.lit(False)).unionByName(many.where((F.col("m") > SHORT) & (F.col("hub") != F.col("node"))).select("hub", "node", F.lit(True).alias("long"))).groupBy("hub", "node").agg(F.max("long").alias("long")), "routes")
    # one text of each class concerned: a filter over its row's slot
    wanted = stage(routes.select("node").union(routes.select("hub")).distinct(), "wanted")
    fbits = filter_bits(wanted.count())
    own = [f"c{i}" for i in range(len(carry))]
    reps = rows.where("n > 0").groupBy("node").agg(F.min(filter_slot(fbits, *own)).alias("slot"), F.max("n").alias("n"))
    reps = stage(wanted.join(reps, "node"), "reps")
    flt = spark.sparkContext.broadcast(filter_flags(reps, fbits))
    sets = d.select(text, filter_slot(fbits, *carry).alias("slot")).mapInArrow(lambda it: _wanted_sets(k, flt.value, shared)(it), "node long, shingles binary")
    links = _links(routes, sets, reps.select("node", "n"), num, den)
    comp = connected_components(links)
    out = rows.join(comp, "node", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "node")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n", "node", "comp")


def _short_pairs(short: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (hub, node) of lists of at most SHORT classes, by the multi-match rule."""
    x = short.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "meta"))).alias("l"))
    two = F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x.node AS node, x.meta AS meta, y.node AS b, y.meta AS mb))))")
    x = x.select(F.explode(two).alias("p")).select("p.*")
    n, n2, need = F.expr("meta div 128"), F.expr("mb div 128"), F.least(F.expr("meta % 128"), F.expr("mb % 128"))
    # Common shingles beyond both prefixes lie behind the shorter-reaching one. Pairs
    # that also meet in a long list are verified there, so c is whole where it decides.
    behind = F.greatest(F.ceil(num * n / den) - F.expr("meta % 128"), F.ceil(num * n2 / den) - F.expr("mb % 128"))
    x = x.where((den * n >= num * n2) & (den * n2 >= num * n)).groupBy(F.col("node").alias("hub"), F.col("b").alias("node"))
    x = x.agg(F.count("*").alias("c"), F.max(need).alias("need"), F.max(behind).alias("behind"), F.max(n + n2).alias("both"))
    return x.where((F.col("c") >= F.col("need")) & ((num + den) * (F.col("c") + F.col("behind")) >= num * F.col("both"))).select("hub", "node")


def _links(routes: DataFrame, sets: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Links that connect what all links among the routes' classes connect: (a, b)."""
    m = routes.join(sizes, "node").groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = lambda m, t: F.greatest(F.ceil(F.col(m) / BLOCK), F.ceil(F.col(t) / BLOCK_SHINGLES)).cast("long")
    m = stage(m.select("hub", blocks("m", "total").alias("parts")), "hubs")
    small = m.where("parts = 1").select("hub")
    one = routes.join(small, "hub").select("hub", "node").unionByName(small.select("hub", F.col("hub").alias("node")))
    zero = F.lit(0).cast("long")
    links = _tiles(one.select("hub", zero.alias("i"), zero.alias("j"), F.lit(2).alias("side"), "node"), sets, num, den, "tile-links")
    m = m.where("parts > 1")
    if not m.limit(1).count():
        return links
    # large groups: first the hub with each member
    members = stage(routes.join(m, "hub").select("hub", "parts", "node", "long"), "large-groups")
    nodes = members.select("node").union(m.select("hub")).distinct()
    sets = stage(nodes.join(sets, "node").dropDuplicates(["node"]), "sets")
    stars = members.select("hub", F.pmod(F.xxhash64("node"), 4 * F.col("parts")).alias("part"), F.lit(1).alias("kind"), "node")
    heads = m.select("hub", F.explode(F.sequence(zero, 4 * F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
    sent = stars.unionByName(heads).join(sets, "node").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    near = stage(sent.select("hub", "kind", "node", "shingles").mapInArrow(_verify_hubs(num, den), "a long, b long"), "hub-links")
    # then those of long lists that stay apart from it with all others of these lists
    group = members.where("long").join(near.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(True).alias("near")), ["hub", "node"], "left")
    group = stage(group.select("hub", "node", F.col("near").isNull().alias("apart")).join(sizes, "node"), "groups")
    g = group.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.max("apart").alias("any")).where("any AND m > 1")
    x = group.join(stage(g.select("hub", blocks("m", "total").alias("nb")), "blocks"), "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")))
    upto = F.sequence(zero, F.col("nb") - 1)
    # tile (i, j): those apart of block i with all of block j, or, where j < i, with those near of block j
    apart = x.where("apart").select("hub", "node", "own", F.explode(upto).alias("k"))
    rows = apart.select("hub", F.col("own").alias("i"), F.col("k").alias("j"), F.when(F.col("k") == F.col("own"), 2).otherwise(0).alias("side"), "node")
    cols = apart.where("k < own").select("hub", F.col("k").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node")
    rest = x.where("NOT apart").select("hub", F.explode(upto).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node")
    far = _tiles(rows.unionByName(cols).unionByName(rest), sets, num, den, "large-tile-links")
    return links.unionByName(near).unionByName(far)


def _tiles(dealt: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """Links of tiles given as rows (hub, i, j, side, node)."""
    sent = dealt.join(sets, "node").select("hub", "i", "j", "side", "node", "shingles").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return stage(sent.mapInArrow(_verify_tiles(num, den), "a long, b long"), name)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; other columns are ignored.

    component_id is the smallest id reachable over links, itself included. Null or
    wordless texts have an empty set and link with nothing; texts of fewer than
    ``k`` words have one shingle, the whole sequence. Rows with a null id keep a
    null component and do not lend their id to one. Repeated rows come out once each.
    An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(linked_rows(d, ["id"], "text", k, num, den), "linked")
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("component_id"))
    # a class or component may hold a third of all rows
    out = join_hot(rows, stage(least, "components"), "comp")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
