"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source of size S (words) and target T takes every document floor(T / S) times
for certain and one more copy of some documents, so that the words taken come to T.
The extra copies are an order sample: a document's rank is its random odds
``u / (1 - u)`` divided by its inclusion odds ``p / (1 - p)``, and a source takes
documents in rising rank up to the word count that is missing (the last one if that
comes nearer). Inclusion probabilities differ between documents: they are the
source's mean f = T / S - floor(T / S), tilted towards longer documents so that the
expected number of words stays f * S.

Ranks are cut into buckets of equal rank probability. Words are summed by source
and bucket, so only the bucket in which a source's missing words run out is sorted,
and gives the source's cut: the last row that is taken once more. Ranks are a function
of a document's id, size and text, so each row then knows its copies from its own
source's cut, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import fresh, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights in turn of the sources by code point, null last.
WEIGHTS = (5, 2, 1)
#: Most copies of a document, strength of the tilt to longer documents (0 to 1), buckets of ranks.
MOST_COPIES, TILT, BUCKETS = 3, 0.5, 4096
SEED = "mix-1"


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the MD5 of a string."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...), one row per source.

    Sources share all words by weight; a target stops at ``most`` times its source's
    size and the rest is shared anew among the others. In order of ``most * size /
    weight`` the sources that stop come first, so a running sum finds the level. The
    table of sources is sorted in one task: it may have millions of rows, not billions.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    # the level rises while sources stop and falls after; at its top it is the level of all that do not stop
    s = s.withColumn("final", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce("final", F.lit(float("inf"))))).drop("weight", "cap", "ratio", "level", "final")


def _sized(docs: DataFrame, text: Column, id_col: str, seed: str) -> list[Column]:
    """What a row's rank depends on: size, text_key, u and len, in this order."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(text, F.lit("")))
    u = uniform(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), key))
    return [size.alias("size"), key.alias("text_key"), u.alias("u"), F.log1p(size).alias("len")]


def _rank(x, s) -> Column:
    """Random odds over inclusion odds of a row ``x`` of a source ``s``."""
    p = s["f"] + s["tilt"] * F.least(s["f"], 1 - s["f"]) * F.coalesce(F.try_divide(x["len"] - s["mid"], s["width"]), F.lit(0.0))
    return (x["u"] / (1 - x["u"])) / (F.greatest(p, F.lit(1e-12)) / F.greatest(1 - p, F.lit(1e-12)))


def _bucket(rank: Column) -> Column:
    return F.floor(rank / (1 + rank) * BUCKETS)


def _cuts(sized: DataFrame, weights: tuple[float, ...], most: int, tilt: float) -> DataFrame:
    """One row per source: its numbers, and where its extra copies end.

    ``sized`` has (source, id, size, text_key, u, len). Rows before the bucket ``edge``
    get an extra copy; of the rows in it those up to the tuple ``cut``, and of the rows
    equal to ``cut`` (repeated rows) the first ``ties``.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.try_divide(F.sum(F.col("size") * F.col("len")), F.sum("size")).alias("mid"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    s = targets(s, weights, most)
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    s = s.withColumn("whole", F.floor(ratio)).withColumn("f", ratio - F.floor(ratio)).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    s = s.withColumn("width", F.greatest(F.col("hi") - F.col("mid"), F.col("mid") - F.col("lo"))).withColumn("tilt", F.lit(float(tilt)))
    s = stage(s.select("source", "source_size", "target", "whole", "f", "missing", "mid", "width", "tilt"), "sources")
    names = [c for c in s.columns if c != "source"]
    d = sized.alias("d").join(s.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", *[f"s.{c}" for c in names])
    d = d.withColumn("rank", _rank(*[{c: F.col(c) for c in d.columns}] * 2)).withColumn("bucket", _bucket(F.col("rank")))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = stage(sums.where((F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing"))).select("source", F.col("bucket").alias("edge"), "before"), "edges")
    # equal rows are one row of the edge bucket with a count, so that repeated rows cannot fill it
    order = F.struct("rank", "id", "size", "text_key")
    at = d.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.edge"))).select("d.*", "e.before")
    at = at.groupBy("source", "rank", "id", "size", "text_key").agg(F.count("*").alias("n"), F.first("missing").alias("missing"), F.first("before").alias("before"))
    running = Window.partitionBy("source").orderBy("rank", "id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("cum", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(running), F.lit(0)))
    fits = F.when(F.col("n") == 1, (F.col("cum") + F.col("size") / 2 <= F.col("missing")).cast("int")).when(F.col("size") == 0, F.when(F.col("cum") <= F.col("missing"), F.col("n")).otherwise(0)).otherwise(F.floor((F.col("missing") - F.col("cum")) / F.nullif("size", F.lit(0)) + F.lit(0.5)))
    at = at.withColumn("ties", F.greatest(F.lit(0), F.least(F.col("n"), fits)).cast("long")).where("ties > 0")
    cut = at.groupBy("source").agg(F.max(order).alias("cut"), F.max_by("ties", order).alias("ties"), F.max_by("n", order).alias("n"))
    e = edge.alias("e").join(cut.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left").select("e.source", "e.edge", "c.cut", "c.ties", "c.n")
    # no edge: the missing words are none, or more than all buckets hold
    end = F.coalesce("edge", F.when(F.col("missing") <= 0, F.lit(-1)).otherwise(F.lit(BUCKETS + 1)))
    s = s.alias("s").join(e.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.*", "e.edge", "e.cut", "e.ties", "e.n")
    return stage(s.withColumn("edge", end), "cuts")


def _copies(df: DataFrame, source: Column, x: dict, cuts: DataFrame, most: int, keep: list[str], new: list[tuple[str, str]]) -> DataFrame:
    """``keep`` of every row and, as ``new`` (name, of), numbers of its source or ``copies``.

    Whether a row has an extra copy follows from the row and its source's cut alone, so
    no row is shuffled but those equal to the cut: repeated rows that share their last copies.
    """
    here = fresh("_cut", [*df.columns, *keep])
    c = cuts.select(F.struct(*cuts.columns).alias(here))
    d = df.join(c, source.eqNullSafe(F.col(here)["source"]))
    s = {n: F.col(here)[n] for n in cuts.columns}
    rank = _rank(x, s)
    bucket, order = _bucket(rank), F.struct(rank.alias("rank"), x["id"].alias("id"), x["size"].alias("size"), x["text_key"].alias("text_key"))
    at = bucket == s["edge"]
    out = lambda extra: {"copies": F.least(s["whole"] + extra.cast("int"), F.lit(most)).cast("long"), **s}
    pick = lambda df, extra: df.select(*keep, *[out(extra)[of].alias(n) for n, of in new])
    within = (bucket < s["edge"]) | F.coalesce(at & (order <= s["cut"]), F.lit(False))
    if not cuts.where("ties < n").limit(1).count():
        return pick(d, within)
    tied, name = F.coalesce(at & order.eqNullSafe(s["cut"]), F.lit(False)), fresh("_nth", d.columns)
    last = d.where(tied).withColumn(name, F.row_number().over(Window.partitionBy(s["source"], rank, x["id"], x["size"], x["text_key"]).orderBy(F.lit(0))))
    return pick(d.where(~tied), within).unionByName(pick(last, F.col(name) <= s["ties"]))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, tilt: float = TILT, seed: str = SEED) -> DataFrame:
    """(id, size, source, source_size, target, copies, text_key) for every row of ``docs``.

    size counts the words of the whole text (null: 0); texts without words are taken
    floor(T / S) times, which adds no words. A null source is a source of its own.
    Equal rows (source, id, text) are interchangeable, so reruns agree. ``copies`` never
    exceeds ``most``. Other columns are ignored. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), *_sized(docs, F.col(text_col), id_col, seed))
    d = stage(d, "sized")
    out = _copies(d, F.col("source"), {c: F.col(c) for c in d.columns}, _cuts(d, weights, most, tilt), most, ["id", "size", "source", "text_key"], [(c, c) for c in ("source_size", "target", "copies")])
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", "text_key")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, tilt: float = TILT, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` as often as ``with_copies`` takes it, with all its columns, whatever their names.

    Texts are read twice and not shuffled. Nulls, repeated rows and empty tables as there.
    """
    x, n, i = (fresh(c, docs.columns) for c in ("_sized", "_copies", "_copy"))
    sized = [*_sized(docs, F.col(text_col), id_col, seed), F.col(id_col).alias("id")]
    narrow = stage(docs.select(F.col(source_col).alias("source"), *sized), "sized")
    cuts = _cuts(narrow, weights, most, tilt)
    d = docs.withColumn(x, F.struct(*sized))
    d = _copies(d, F.col(source_col), {c: F.col(x)[c] for c in ("size", "text_key", "u", "len", "id")}, cuts, most, docs.columns, [(n, "copies")])
    return d.where(F.col(n) > 0).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)
