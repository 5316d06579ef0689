"""Reply trees: paths from root to leaf, ranked by score, each formatted as one conversation.

Messages form trees by ``(tree, node, parent)``.  Iterative self-joins double the reach of each
node's ancestor pointer, so that depth d takes log2(d) joins and every round keeps one row per
message.  The last round knows each node's root, depth and the score of its branch; leaves are
ranked by it per tree.  Only the chosen paths are then enumerated, by the same pointers from the
longest to the shortest: each join doubles the part of the path that is known.

Texts travel once, at the end.  Format of a turn: ``<turn ROLE>TEXT</turn>`` and a newline; ``&``,
``<`` and ``>`` inside roles and texts are written ``&amp;``, ``&lt;`` and ``&gt;``, which is
reversible, so no text can imitate a control string.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialops.llm.common import stored

END = "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each row answers the one before it.

    Rows are ordered by turn, then role and text, so that repeated turns have a defined place.
    A null ``conv_id`` names a conversation of its own.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text")
    place = F.row_number().over(by).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree"),
        place.alias("node"),
        F.when(place > 1, place - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _up(rows: DataFrame, pointers: DataFrame) -> DataFrame:
    """Join each row's node with what it points to."""
    return rows.join(pointers, _same(rows["tree"], pointers["_tree"]) & (rows["node"] == pointers["_node"])).drop("_tree", "_node")


def best_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per message of each chosen path: tree, leaf, rank, place (from 0 at the root), node.

    Paths of a tree are ranked by the sum of their scores, ties to the smaller leaf; ``keep`` of
    them stay, all by default.  A null score counts 0.  A parent that is not in the tree makes a
    root.  Messages on a cycle reach no root and lie on no path.  Nodes are unique within a tree.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    linked = nodes.join(known, _same(nodes["tree"], known["_tree"]) & (nodes["parent"] == known["_node"]), "left")
    state = stored(linked.select("tree", "node", F.col("_node").alias("up"), "score", F.when(F.col("_node").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "tree")
    rounds, levels = 1 + math.ceil(math.log2(max(2, state.count()))), []
    while len(levels) < rounds and not state.where("up IS NOT NULL").isEmpty():
        levels.append(state.where("up IS NOT NULL").select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "up"))
        above = state.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        waiting = state.where("up IS NOT NULL")
        reached = _up(waiting.withColumnRenamed("node", "_own").withColumnRenamed("up", "node"), above).select(
            "tree",
            F.col("_own").alias("node"),
            F.col("_up").alias("up"),
            (F.col("score") + F.col("_score")).alias("score"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        state = stored(state.where("up IS NULL").unionByName(reached), "tree")
    parents = nodes.select(F.col("tree").alias("_tree"), F.col("parent").alias("_parent")).where("_parent IS NOT NULL").distinct()
    ended = state.where("up IS NULL")
    leaves = ended.join(parents, _same(ended["tree"], parents["_tree"]) & (ended["node"] == parents["_parent"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    paths = ranked.select("tree", F.col("node").alias("leaf"), "rank", "score", F.col("depth").alias("place"), "node")
    for k in reversed(range(len(levels))):
        further = _up(paths, levels[k]).select("tree", "leaf", "rank", "score", (F.col("place") - 2**k).alias("place"), F.col("up").alias("node"))
        paths = paths.unionByName(further)
        if k:
            paths = stored(paths, "paths")
    return paths


def formatted(messages: DataFrame, keep: int | None = None, learn: str = "assistant") -> DataFrame:
    """Each chosen path as one text: tree, leaf, rank, score, formatted, loss.

    ``loss`` lists (start, length) in code points of the escaped texts of ``learn``'s turns; an
    empty text has a mask of length 0.  A null role or text is empty.
    """
    paths = best_paths(messages, keep)
    texts = messages.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "role", "text")
    role, text = (escaped(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit("<turn "), role, F.lit(">"))
    turns = _up(paths, texts).select(
        "tree", "leaf", "rank", "score", "place", F.concat(head, text, F.lit(END)).alias("piece"),
        F.length(head).alias("head"), F.length(text).alias("body"), (F.coalesce("role", F.lit("")) == learn).alias("learned"),
    )
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head"))
    whole = placed.groupBy("tree", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "start", "body", "learned"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].cast("int").alias("start"), t["body"].alias("length")))
    return whole.select("tree", "leaf", "rank", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """The turns (role, text) and the learned text, parsed from ``formatted`` and ``loss`` alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, "(?s)^<turn ([^>]*)>(.*)$", 1)).alias("role"),
            unescaped(F.regexp_extract(p, "(?s)^<turn ([^>]*)>(.*)$", 2)).alias("text"),
        ),
    )
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return conversations.withColumn("turns", parsed).withColumn("learned", learned)
