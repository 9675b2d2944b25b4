"""Chat formatting of reply trees, in DataFrame functions only.

Messages reply to messages of their conversation. Self-joins with doubling distance find for every message
its ancestor 1, 2, 4, ... replies up, and with them the length and score of every root-to-leaf path: a thread
of n replies takes log2(n) joins. The best leaves are chosen by score, their paths are enumerated through
the same tables, and each chosen path is formatted as one conversation with a loss mask over the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from digitscope.llm.shared import stored

# The template. Texts hold no "<" after escaping, so marks cannot be forged.
OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    r"""Backslashes become ``\b`` and ``<`` becomes ``\l``; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Undo ``escaped``: every backslash of an escaped text is followed by its letter."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as reply trees without branches: each turn replies to the one before.

    Ties of ``turn`` go by role and text; null turns come first. Returns ``conv, node, parent, role, text, score``.
    """
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    node = F.row_number().over(order).cast("bigint")
    return rows.select(F.col(conv).alias("conv"), node.alias("node"), F.col(role).alias("role"), F.col(text).alias("text")).select(
        "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``(tree, node, up)`` of ancestors 1, 2, 4, ... replies up, and ``(tree, node, length, score)`` of whole paths."""
    own = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "parent")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    now = stored(own.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("length"), "score"))
    largest = now.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    ended, open_ = now.where(F.col("up").isNull()), now.where(F.col("up").isNotNull())
    tables = []
    # Only messages with an ancestor at the distance go on; once the distance exceeds every tree, they go round a circle.
    for _ in range(largest.bit_length()):
        if not open_.limit(1).count():
            break
        tables.append(open_.select("tree", "node", "up"))
        above = open_.unionByName(ended).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("length").alias("more"), F.col("score").alias("extra"))
        now = stored(open_.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("length") + F.col("more")).alias("length"), (F.col("score") + F.col("extra")).alias("score")))
        ended, open_ = ended.unionByName(now.where(F.col("up").isNull())), now.where(F.col("up").isNotNull())
    return tables, ended.select("tree", "node", "length", "score")


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of every reply tree, each formatted as one conversation.

    ``messages`` has ``conv, node, parent, role, text`` and ``score``. A path's score is the mean of its
    messages'; ties go to the longer path, then to the smaller leaf. Returns ``conv, branch`` (rank from
    1), ``formatted`` and ``loss array<struct<start, end>>``: code points of ``formatted`` that hold the
    assistant's texts, the end exclusive.

    A null conversation is one of its own; a parent that is missing makes its message a root; null nodes
    and messages whose ancestors go in a circle are left out; of a repeated (conversation, node) one stays.
    Null roles, texts and scores count as empty and 0. A path is one row of the result, so its turns meet in
    one task; trees do not otherwise.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    nodes = stored(messages.where(F.col("node").isNotNull()).select(tree.alias("tree"), "conv", "node", "parent", "role", "text", "score")
                   .groupBy("tree", "node").agg(*[F.min(F.struct("parent", "role", "text", "score", "conv")).alias("m")]).select("tree", "node", "m.*"))
    tables, whole = _jumps(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node")).where(F.col("node").isNotNull()).distinct()
    mean = F.col("score") / F.col("length")
    ranked = whole.join(parents, ["tree", "node"], "left_anti").withColumn("branch", F.row_number().over(
        Window.partitionBy("tree").orderBy(mean.desc(), F.col("length").desc(), "node"))).where(F.col("branch") <= branches)
    path = stored(ranked.select("tree", "branch", "node", F.lit(0).cast("bigint").alias("back")))
    for k, table in enumerate(tables):
        path = path.unionByName(stored(path.join(table, ["tree", "node"]).select(
            "tree", "branch", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))))

    head = F.concat(F.lit(OPEN), _escaped_role(F.col("role")), F.lit(MIDDLE))
    turns = path.join(nodes, ["tree", "node"]).select(
        "tree", "branch", "back", "conv", head.alias("head"), escaped(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("tree", "branch").orderBy(F.col("back").desc())
    start = (F.sum(size.cast("bigint")).over(order) - F.length("body") - len(CLOSE))
    turns = turns.withColumn("start", start)
    mask = F.when(F.col("learn"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    return turns.groupBy("tree", "branch").agg(
        F.first("conv").alias("conv"),
        F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), mask.alias("mask")))).alias("turns"),
    ).select("conv", "branch", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
             F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("loss"))


def turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``, unescaped."""
    parts = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda t: F.struct(
        _unescaped_role(F.substr(F.substring_index(t, MIDDLE, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescaped(F.substr(t, F.length(F.substring_index(t, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its parts."""
    return F.array_join(F.transform(loss, lambda m: unescaped(
        F.substr(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
