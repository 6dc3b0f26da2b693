"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; it is named by its smallest member and its
depth, so the row (conversation, depth) of any member leads to it and the ancestors of a
node are the rows of its smallest member. Sequences are told apart by two 64-bit hashes,
each the exclusive or of hashes of (position, turn), which makes prefixes a running
aggregate that long conversations compute in blocks.

The rollup recursively splits the tree at centroids. A component's nodes whose subtree
holds more than half of its weight form the path from its top to its centroid: the total
below the centroid is added along that path, the path's subtree weights shrink by the
centroid's, and the centroid's removal leaves components of at most half the weight.
Weights are member rows, known from counting alone. Components of up to COMPONENT nodes
finish inside tasks by the same recursion; larger ones are split by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import join_hot, stage

#: Nodes of a component that one task finishes, nodes of a batch of such components.
COMPONENT, BATCH = 4096, 65536
#: Positions of a conversation that one window spans, ids whose text is joined before hashing.
BLOCK, IDS = 4096, 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, d1, d2, bytes): turns numbered from 0 by turn (null first), role, text, each with two digests.

    A range partitioning by (conv_id, turn) numbers them, so a conversation that holds a
    third of all rows is spread; rows equal in both are sorted in one task. Null role or
    text is empty; rows without conv_id take no part.
    """
    c = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    c = c.repartitionByRange("conv_id", F.asc_nulls_first("turn")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    digests = [F.xxhash64(F.lit(k), "role", "text").alias(f"d{k}") for k in (1, 2)]
    c = stage(c.select("conv_id", F.monotonically_increasing_id().alias("at"), *digests, F.octet_length("text").cast("long").alias("bytes")), "turns")
    c = c.withColumn("piece", F.shiftright("at", 33))
    parts = c.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "piece", F.coalesce(before, F.lit(0)).alias("before"))
    local = c.withColumn("local", F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("at")))
    return stage(local.join(parts, ["conv_id", "piece"]).select("conv_id", (F.col("before") + F.col("local") - 1).alias("no"), "d1", "d2", "bytes"), "numbered")


def shared_openings(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``head`` turns replaced by those of conversation ``base``.

    ``base`` and ``head`` (at most ``most``) are expressions of conv_id; a base that is
    absent gives no turns. Returns (conv_id, len), turnless conversations too, and
    (conv_id, depth, d1, d2, bytes) with depths from 1.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "head": head.cast("long")})
    ids = stage(ids, "lengths")
    lengths = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(lengths, "base", "left").withColumn("shared", F.least("head", F.coalesce("base_n", F.lit(0))))
    ids = stage(ids.select("conv_id", "base", "head", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("len")), "openings")
    opening = turns.where(F.col("no") < most).withColumnRenamed("conv_id", "base").join(ids.where("shared > 0"), "base").where("no < shared")
    own = turns.join(ids, "conv_id").where("no >= head").withColumn("no", F.col("no") - F.col("head") + F.col("shared"))
    cols = ["conv_id", (F.col("no") + 1).alias("depth"), "d1", "d2", "bytes"]
    return ids.select("conv_id", "len"), own.select(cols).unionByName(opening.select(cols))


def prefixes(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, bytes, len) of every prefix of every conversation, the empty one with depth 0 too."""
    t = turns.select("conv_id", "depth", *[F.xxhash64(F.lit(k), "depth", "d1", "d2").alias(f"h{k}") for k in (1, 2)], "bytes", F.floor(F.col("depth") / BLOCK).alias("block"))
    t = stage(t, "positions")
    up_to = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "block").agg(*[F.bit_xor(f"h{k}").alias(f"b{k}") for k in (1, 2)])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{k}").over(up_to), F.lit(0).cast("long")).alias(f"c{k}") for k in (1, 2)])
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "block", "depth", "bytes", *[F.bit_xor(f"h{k}").over(within).alias(f"k{k}") for k in (1, 2)]).join(blocks, ["conv_id", "block"])
    t = t.join(lengths, "conv_id").select("conv_id", "depth", *[F.col(f"k{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"k{k}") for k in (1, 2)], "bytes", "len")
    zero = F.lit(0).cast("long")
    return t.unionByName(lengths.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"), "len"))


def _jump(par: np.ndarray) -> np.ndarray:
    """The top that every node reaches: tops are their own parents."""
    while not np.array_equal(up := par[par], par):
        par = up
    return par


def roll_up(conv: np.ndarray, depth: np.ndarray, parent: np.ndarray, top: np.ndarray, sub: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of ``values`` inside each component, by centroids; ``top`` marks the components' tops, ``sub`` are subtree weights."""
    me, sub, depth = np.arange(len(conv)), sub.copy(), depth - depth.min()
    ids, width = np.unique(np.concatenate([conv, parent])), int(depth.max()) + 2
    code = np.searchsorted(ids, conv) * width + depth
    order = np.argsort(code)
    above = np.searchsorted(ids, parent) * width + depth - 1
    par = np.where(top, me, order[np.minimum(np.searchsorted(code[order], above), len(me) - 1)])
    alive, out = np.ones(len(me), bool), [np.zeros_like(v) for v in values]
    while alive.any():
        root = _jump(par)
        heavy = alive & (2 * sub > sub[root])  # the paths from tops to centroids
        low = np.full(len(me), -1)
        np.maximum.at(low, root[heavy], depth[heavy])
        g = np.flatnonzero(heavy & (depth == low[root]))
        centroid = me.copy()
        centroid[root[g]] = g
        mine = centroid[root]
        cut = par.copy()
        cut[g] = g
        under = alive & (_jump(cut) == mine)
        for v, acc in zip(values, out, strict=True):
            total = np.zeros_like(v)
            np.add.at(total, mine[under], v[under])
            acc[heavy] += total[mine[heavy]]
        path = heavy & (me != mine)
        sub[path] -= sub[mine[path]]
        gone = np.zeros(len(me), bool)
        gone[g] = True
        par = np.where(gone[par] | gone, me, par)
        alive[g] = False
    return out


def _finish(names: list[str], size: int):
    """Roll up whole components in batches of about ``size`` nodes; rows come by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            col = {n: t.column(n).to_numpy() for n in t.column_names}
            top = (col["conv_id"] == col["top_conv"]) & (col["depth"] == col["top_depth"])
            sums = roll_up(col["conv_id"], col["depth"], col["parent_conv_id"], top, col["sub"], [col[n] for n in names])
            return pa.RecordBatch.from_pydict({"conv_id": col["conv_id"], "depth": col["depth"]} | {f"acc_{n}": s + col[f"acc_{n}"] for n, s in zip(names, sums, strict=True)})

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= size:
                t = pa.concat_tables(held).combine_chunks()
                c, d = t.column("top_conv").to_numpy(), t.column("top_depth").to_numpy()
                edge = np.flatnonzero((c[1:] != c[:-1]) | (d[1:] != d[:-1]))
                if len(edge):  # the last component may go on in the next batch
                    k = int(edge[-1]) + 1
                    yield done(t.slice(0, k).combine_chunks())
                    held = [t.slice(k)]
        if held and sum(map(len, held)):
            yield done(pa.concat_tables(held).combine_chunks())

    return run


def centroid_rollup(nodes: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, depth, values): sums of long columns over every node's subtree, itself included.

    ``nodes``: conv_id, depth, parent_conv_id (null for a root), weight (subtree's number
    of member rows) and the values. ``rows``: (conv_id, depth, node, above) leads from a
    conversation's position to its node's conv_id and that of the node above. Any number
    of trees; no nodes give no rows.
    """
    comp = F.struct(F.col("top_conv").alias("c"), F.col("top_depth").alias("d"))
    root = nodes.where("parent_conv_id IS NULL").select(F.col("conv_id").alias("top_conv"), F.col("depth").alias("top_depth"))
    at_root = rows.select("conv_id", "depth", F.col("node").alias("top_conv")).join(root.withColumnRenamed("top_depth", "depth"), ["depth", "top_conv"]).select("conv_id", "top_conv", F.col("depth").alias("top_depth"))
    state = nodes.join(at_root, "conv_id").select("conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), "top_conv", "top_depth", F.col("weight").alias("sub"), *values, *[F.lit(0).cast("long").alias(f"acc_{v}") for v in values])
    state, small, done = stage(state.withColumn("comp", comp), "forest"), [], []
    while True:
        comps = stage(state.groupBy("comp").agg(F.max("sub").alias("all"), F.count("*").alias("n")), "components")
        sized = join_hot(state, comps, "comp")
        small.append(sized.where(F.col("n") <= COMPONENT).drop("all", "n", "comp"))
        if comps.where(F.col("n") > COMPONENT).limit(1).count() == 0:
            break
        big = sized.where(F.col("n") > COMPONENT).withColumn("heavy", 2 * F.col("sub") > F.col("all"))
        cent = stage(big.where("heavy").groupBy("comp").agg(F.max(F.struct("depth", "conv_id", "sub")).alias("g")), "centroids")
        big = join_hot(big, cent, "comp").withColumn("e", F.when(F.col("depth") > F.col("g.depth"), F.col("g.depth") + 1))
        way = rows.select("conv_id", F.col("depth").alias("e"), F.col("node").alias("child"), "above")
        big = big.join(way, ["conv_id", "e"], "left").withColumn("is_g", (F.col("conv_id") == F.col("g.conv_id")) & (F.col("depth") == F.col("g.depth")))
        split = stage(big.withColumn("below", F.coalesce(F.col("above") == F.col("g.conv_id"), F.lit(False))).drop("above", "all", "n"), "split")
        totals = stage(split.where("below OR is_g").groupBy("comp").agg(*[F.sum(v).alias(f"t_{v}") for v in values]), "totals")
        split = join_hot(split, totals, "comp")
        path = {f"acc_{v}": F.col(f"acc_{v}") + F.when(F.col("heavy"), F.col(f"t_{v}")).otherwise(0) for v in values}
        path |= {"sub": F.col("sub") - F.when(F.col("heavy") & ~F.col("is_g"), F.col("g.sub")).otherwise(0)}
        down = {"top_conv": F.when(F.col("below"), F.col("child")).otherwise(F.col("top_conv")), "top_depth": F.when(F.col("below"), F.col("e")).otherwise(F.col("top_depth"))}
        nxt = split.withColumns(path | down).withColumn("comp", comp)
        nxt = stage(nxt.select(*state.columns, "is_g"), "forest")
        done.append(nxt.where("is_g").select("conv_id", "depth", *[f"acc_{v}" for v in values]))
        state = nxt.where("NOT is_g").drop("is_g")
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    rest = rest.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth")
    out = rest.mapInArrow(_finish(values, BATCH), "conv_id long, depth long, " + ", ".join(f"acc_{v} long" for v in values))
    for d in done:
        out = out.unionByName(d)
    return out.select("conv_id", "depth", *[F.col(f"acc_{v}").alias(v) for v in values])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over texts that come in order, comma-joined."""
    now, h = None, None
    for batch in batches:
        out = []
        for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
            if key != now:
                if now:
                    out.append((*now, h.hexdigest()))
                now, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("conv_id", "depth", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
    if now:
        yield pa.RecordBatch.from_pydict({"conv_id": [now[0]], "depth": [now[1]], "ends_sha256": [h.hexdigest()]})


def ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of the conversations that end at each node (node, depth, conv_id)."""
    texts = rows.groupBy("node", "depth", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    texts = texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return texts.select("node", "depth", "ids").mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node of the trie of ``turns`` (conv_id, depth, d1, d2, bytes); ``lengths`` (conv_id, len) has turnless conversations too.

    conv_id is the node's smallest member; n_convs its members, n_children its children,
    n_leaves the childless nodes of its subtree, saved_tokens the bytes of the subtree's
    last texts times their members but one, ends_sha256 the digest of the members that
    end here. No conversations give no rows, not even a root.
    """
    rows = stage(prefixes(lengths, turns), "prefixes")
    nodes = rows.groupBy("k1", "k2", "depth").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight")
    )
    nodes = stage(nodes, "keys")
    led = stage(rows.join(nodes.select("k1", "k2", "depth", "node"), ["k1", "k2", "depth"]).select("conv_id", "depth", "node", (F.col("depth") == F.col("len")).alias("last")), "led")
    up = led.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    led = stage(led.join(up, ["conv_id", "depth"], "left"), "ways")
    nodes = nodes.withColumnRenamed("node", "conv_id").join(led.where("conv_id = node").select("conv_id", "depth", F.col("above").alias("parent_conv_id")), ["conv_id", "depth"])
    kids = nodes.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.drop("k1", "k2").join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    nodes = stage(nodes.withColumns(own), "nodes")
    sums = centroid_rollup(nodes, led.select("conv_id", "depth", "node", "above"), list(own))
    last = ends(led.where("last").select("node", "depth", "conv_id"))
    out = nodes.drop("weight", "bytes", *own).join(sums, ["conv_id", "depth"]).join(last, ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def shared_prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the conversations after each takes the first crc32(conv_id) mod 9 turns of conversation conv_id - conv_id mod 5.

    Turns go by turn (null first), role, text; null role or text is empty; rows without
    conv_id take no part; mod has the dividend's sign; other columns are ignored.
    """
    c = F.col("conv_id")
    return prefix_trie(*shared_openings(ordered_turns(conversations), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8))
