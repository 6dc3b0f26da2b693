"""Spelling variants: words at one edit, found by a frontier of states over a relational trie.

The trie is a table of edges between nodes that branch or end a word, so an edge carries
the characters up to the next such node. A state (word, position, node, edits) moves by
equi-joins with that table, level by level; a state that ends with one edit at a
word's end has found a neighbour. Two words at one edit agree in the first or in the
last half of either, so the trie holds every word forwards and backwards, edits are
tried only from a word's middle on, and nodes above the middle are not built. An edit is
tried where it differs from no edit: a run of equal characters loses or gains its last
one, which only happens at nodes. Each edge knows which characters may follow, and a
state that could not move on is not made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import stage

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What follows the last character of a word, and the longest prefix that names its node in clear.
END, CLEAR = "\u0000", 32


def word_counts(docs: DataFrame, least_chars: int = 5, least_count: int = 3, drop_one_in: int = 97) -> DataFrame:
    """(word, n): runs of letters over whole texts, A-Z lower-cased, by occurrences.

    Where crc32 of "doc_id:run" is divisible by ``drop_one_in``, the run loses its code
    point at that number modulo its length. Null texts have no runs; a null doc_id is an
    empty one. Other columns are ignored.
    """
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    run = run.where(F.length("run") >= least_chars)
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    run = run.select(low.alias("run"), F.crc32(F.concat_ws(":", "doc_id", low).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = run.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    # the length is an aggregate, as a filter on the word would compute it again below
    words = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.length("word")).alias("chars"))
    return words.where((F.col("n") >= least_count) & (F.col("chars") >= least_chars)).drop("chars")


def _node(way: Column, prefix: Column) -> Column:
    """A node's name: its prefix, or where that is long a digest of it, longer than any prefix in clear."""
    return F.concat(way, F.when(F.length(prefix) <= CLEAR, prefix).otherwise(F.concat(F.lit("#"), F.md5(prefix.cast("binary")))))


def _char(text: str, at: Column) -> Column:
    """The character at a position from 0, or END."""
    return F.when(at < F.length(text), F.substring(F.col(text), at + 1, F.lit(1))).otherwise(F.lit(END))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes on each word's way, edges) of the trie of ``words`` (word), forwards and backwards.

    Ways: way ("f", "r"), s (the word that way), at (the node's depth), node, kids (the
    characters that follow it). Edges: node, ch (first character), label, child, kids (of
    the child), ends (the word that ends at the child, or null). Depths start where edits
    of words one character shorter do.
    """
    s = words.select(F.lit("f").alias("way"), F.col("word").alias("s")).unionByName(words.select(F.lit("r").alias("way"), F.reverse("word").alias("s")))
    n = F.length("s")
    first = F.when(F.col("way") == "f", F.floor((n - 1) / 2)).otherwise(n - 1 - F.floor((n - 1) / 2)).cast("int")
    at = s.select("way", "s", F.explode(F.sequence(first, n)).alias("at"))
    at = at.select("way", "s", "at", _node(F.col("way"), F.substring(F.col("s"), F.lit(1), F.col("at"))).alias("node"), _char("s", F.col("at")).alias("ch"))
    kids = at.select("node", "ch").distinct().groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("ch")), "").alias("kids"))
    kids = kids.where((F.length("kids") > 1) | (F.col("kids") == END))
    ways = at.drop("ch").join(kids, "node")
    along = Window.partitionBy("way", "s").orderBy("at")
    nxt = F.lead(F.struct("at", "node", "kids")).over(along)
    ways = stage(ways.withColumn("next", nxt), "ways")
    label = F.substring(F.col("s"), F.col("at") + 1, F.col("next.at") - F.col("at"))
    ends = F.when(F.startswith(F.col("next.kids"), F.lit(END)), F.substring(F.col("s"), F.lit(1), F.col("next.at")))
    edges = ways.where("next IS NOT NULL").select("node", F.substring(label, 1, 1).alias("ch"), label.alias("label"), F.col("next.node").alias("child"), F.col("next.kids").alias("kids"), ends.alias("ends"))
    edges = edges.groupBy("node", "ch").agg(*[F.min(c).alias(c) for c in ("label", "child", "kids", "ends")])
    return ways.select("way", "s", "at", "node", "kids"), stage(edges, "edges")


def _moved(states: DataFrame) -> DataFrame:
    """States whose next character may follow at their node: at the word's end, only where a word ends."""
    return states.where(F.contains(F.col("kids"), F.col("next"))).drop("kids", "next")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of ``words`` (word: distinct, not empty) that differ by one inserted, deleted or replaced code point.

    Rounds are as many as nodes lie on a word's way from an edit to its end.
    """
    ways, edges = trie(words)
    n, at, own = F.length("s"), F.col("at"), _char("s", F.col("at"))
    middle = F.when(F.col("way") == "f", F.floor(n / 2)).otherwise(n - F.floor(n / 2))
    clean = ways.where(at >= middle).withColumn("own", own)
    # edits: the trie's character replaces ours or comes before it, or ours is left out
    size, rest = F.length("label"), F.expr("substring(label, 2)")
    met = clean.drop("kids").join(edges, "node").where(F.col("ch") != F.col("own"))
    replaced = (at < n) & F.contains("kids", _char("s", at + size)) & (rest == F.substring(F.col("s"), at + 2, size - 1))
    inserted = F.contains("kids", _char("s", at + size - 1)) & (rest == F.substring(F.col("s"), at + 1, size - 1))
    met = met.withColumns({"r": replaced, "i": inserted}).where("r OR i")
    to = F.explode(F.array(F.when(F.col("r"), at + size), F.when(F.col("i"), at + size - 1)))
    met = met.select("way", "s", to.alias("at"), F.col("child").alias("node"), "ends").where("at IS NOT NULL")
    left_out = clean.where(at < n).withColumn("next", _char("s", at + 1)).where(F.col("next") != F.col("own"))
    left_out = _moved(left_out.withColumn("at", at + 1).withColumn("ends", F.when(F.col("at") == n, F.substring(F.col("s"), F.lit(1), n - 1))))
    frontier = stage(met.unionByName(left_out.select(met.columns)), "frontier")
    found = []
    while True:
        found.append(frontier.where(at == n).select("way", "s", "ends"))
        live = frontier.where(at < n)
        if not live.limit(1).count():
            break
        step = live.drop("ends").withColumn("ch", own).join(edges, ["node", "ch"]).where(F.substring(F.col("s"), at + 1, size) == F.col("label"))
        step = step.select("way", "s", (at + size).alias("at"), F.col("child").alias("node"), "kids", "ends")
        frontier = stage(_moved(step.withColumn("next", own)).select(frontier.columns), "frontier")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    turn = lambda c: F.when(F.col("way") == "f", F.col(c)).otherwise(F.reverse(c))
    return out.select(turn("s").alias("word"), turn("ends").alias("near")).distinct()


def variants(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of ``counts`` (word, n).

    A word's form is its neighbour of largest n (ties: first by code points) if that has at
    least twice the word's n; its root is where forms lead, the word itself without one.
    Counts double at every step, so the rounds that follow the forms are few. No words
    give no rows.
    """
    w = stage(counts.select("word", "n"), "words")
    near = stage(neighbours(w.select("word")), "near").join(w.withColumnRenamed("word", "near"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    w = w.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.n") >= 2 * F.col("n"), F.col("best.near")).alias("form"), (-F.col("best.n")).alias("form_n"))
    w = stage(w.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n"))), "forms")
    lead = w.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        up = lead.select(F.col("word").alias("root"), F.col("root").alias("up"))
        nxt = stage(lead.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("on")), "roots")
        lead = nxt.drop("on")
        if not nxt.where("on").limit(1).count():
            break
    return w.join(lead, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text) of at least 5 letters and 3 occurrences, with their neighbours, forms and roots."""
    return variants(word_counts(docs))
