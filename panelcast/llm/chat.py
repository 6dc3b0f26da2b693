"""Chat formatting of reply trees with DataFrame functions only.

Messages form trees by parent. Root-to-leaf paths of the chosen leaves come from
self-joins that double their reach: every round joins each message's 2**r-th
ancestor with itself and adds to each path the ancestors that far above it, so a
tree of depth D takes log2(D) rounds and rows in proportion to the paths' length.
Leaves are ranked within their tree by the sum of scores along the path.

Template of one turn: ``<s>role[INST]text</s>``, turns one after the other. A
backslash goes after the first character of every control string inside a role or
text, and backslashes are doubled, so control strings mark turns alone and the text
can be restored. The loss mask is the list of spans of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import stage

OPEN, SEP, CLOSE = "<s>", "[INST]", "</s>"
#: Control strings that texts may not hold unescaped.
CONTROL = r"<(?=/?s>)|\[(?=/?(?:INST|SYS)\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain_messages(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of linear conversations: each row replies to the one before it by turn.

    Rows of equal turn follow each other by role and text; null roles and texts are
    empty; a null conversation is a tree of its own. Every row scores 1.
    """
    c = conversations.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    c = c.withColumn("id", n)
    return c.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def unique(messages: DataFrame) -> DataFrame:
    """One message for each (tree, id): the smallest by parent, role, text and score."""
    cols = ("parent", "role", "text", "score")
    return messages.groupBy("tree", "id").agg(F.min(F.struct(*cols)).alias("m")).select("tree", "id", *[F.col("m")[c].alias(c) for c in cols])


def best_paths(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, depth, id) of every message on the ``per_tree`` best root-to-leaf paths (None: all).

    Ids are unique within a tree. A leaf's score is the sum of scores on its path; ties
    go to the smaller leaf id. A message whose parent does not exist is a root. Messages
    whose parents form a ring, and those below one, are on no path from a root and left
    out: they are what still has an ancestor after as many rounds as any chain can take.
    """
    m = messages.select("tree", "id", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    ids = m.select("tree", "id")
    m = m.alias("m").join(ids.alias("p"), _same("m", "p") & (F.col("m.parent") == F.col("p.id")), "left").select("m.tree", "m.id", F.col("p.id").alias("up"), "m.score")
    # up: the 2**r-th ancestor; total: scores of the message and the 2**r - 1 above it
    jump = stage(m.select("tree", "id", "up", F.col("score").alias("total")), "jump-0")
    jumps, longest = [jump], jump.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    while len(jumps) <= longest.bit_length() and jumps[-1].where("up IS NOT NULL").limit(1).count():
        j = jumps[-1]
        far = j.where("up IS NOT NULL").alias("a").join(j.alias("b"), _same("a", "b") & (F.col("a.up") == F.col("b.id")))
        far = far.select("a.tree", "a.id", F.col("b.up").alias("up"), (F.col("a.total") + F.col("b.total")).alias("total"))
        jumps.append(stage(far.unionByName(j.where("up IS NULL")), f"jump-{len(jumps)}"))
    parents = jump.where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = jumps[-1].where("up IS NULL").alias("l").join(parents.alias("p"), _same("l", "p") & (F.col("l.id") == F.col("p.id")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    leaves = leaves.select("tree", F.col("id").alias("leaf"), "total").withColumn("rank", rank)
    if per_tree is not None:
        leaves = leaves.where(F.col("rank") <= per_tree)
    paths = leaves.select("tree", "leaf", "rank", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("above"))
    for r, j in enumerate(jumps[:-1]):
        up = paths.alias("a").join(j.where("up IS NOT NULL").alias("b"), _same("a", "b") & (F.col("a.id") == F.col("b.id")))
        paths = stage(paths.unionByName(up.select("a.tree", "a.leaf", "a.rank", F.col("b.up").alias("id"), (F.col("a.above") + (1 << r)).alias("above"))), f"paths-{r}")
    return paths


def format_paths(messages: DataFrame, per_tree: int | None = 1, ids_unique: bool = False) -> DataFrame:
    """One conversation for each chosen path: (tree, leaf, rank, formatted, loss_spans as array<struct<start, length>> from 0).

    Of messages that repeat an id within a tree one counts (``unique``); ``ids_unique`` says that none do.
    """
    if not ids_unique:
        messages = stage(unique(messages), "messages")
    paths = best_paths(messages, per_tree)
    m = messages.select("tree", "id", escape(F.coalesce("role", F.lit(""))).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"), (F.coalesce("role", F.lit("")) == LOSS_ROLE).alias("loss"))
    j = paths.alias("a").join(m.alias("m"), _same("a", "m") & (F.col("a.id") == F.col("m.id"))).select("a.tree", "a.leaf", "a.rank", "a.above", "m.r", "m.t", "m.loss")
    j = j.withColumn("turn", F.concat(F.lit(OPEN), "r", F.lit(SEP), "t", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + len(OPEN) + F.length("r") + len(SEP)
    j = j.withColumn("start", start.cast("long"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "turn", "loss", "start", F.length("t").cast("long").alias("length"))))
    g = j.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), rows.alias("rows"))
    spans = F.transform(F.filter("rows", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return g.select("tree", "leaf", "rank", F.array_join(F.transform("rows", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: F.length(t) > 0)
    inner = F.transform(turns, lambda t: F.substring(t, len(OPEN) + 1, 2147483647))
    return F.transform(inner, lambda t: F.struct(unescape(F.substring_index(t, SEP, 1)).alias("role"), unescape(t.substr(F.length(F.substring_index(t, SEP, 1)) + len(SEP) + 1, F.lit(2147483647))).alias("text")))


def formatted_digests(conversations: DataFrame) -> DataFrame:
    """Format conversations and read turns and loss texts back; one row per conv_id (a null one too). An empty table gives no rows."""
    f = format_paths(chain_messages(conversations), ids_unique=True).withColumn("turns", parse_turns(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    f = f.withColumn("loss", loss)
    return f.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
