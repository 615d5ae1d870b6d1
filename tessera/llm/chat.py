"""Chat formatting over reply trees, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.storage import cut

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """Put a backslash behind every `<`, `[` and backslash: no marker or control string survives in a text."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """nodes(tree, node, parent): (tree, leaf, node, up), one row for each node above or at each leaf.

    up counts the steps from the leaf. Self-joins double the reach each round: after k rounds every path holds
    its last 2^k nodes, so a thread of n replies takes log n rounds, and the rows never exceed the result. A
    parent that doesn't exist makes its child a root. Replies in a circle raise an error.
    """
    ids = nodes.select("tree", "node").distinct()
    jump = nodes.select("tree", "node", F.col("parent").alias("above")).join(ids.select("tree", F.col("node").alias("above")), ["tree", "above"])
    jump = cut(jump.select("tree", "node", "above"), "jumps")
    parents = jump.select("tree", F.col("above").alias("node"))
    paths = ids.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    step, limit = 1, 2 * ids.count()
    while not jump.isEmpty():
        if step > limit:
            raise ValueError("replies form a circle")
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        paths = cut(paths.union(more), "paths")
        far = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        jump = cut(jump.join(far, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), "jumps")
        step *= 2
    return paths


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """nodes(tree, node, parent, score): the `top` paths of each tree by their summed score, as (tree, leaf, rank, node, up).

    Null scores count as zero; ties go to the smaller leaf.
    """
    paths = root_to_leaf_paths(nodes)
    scored = paths.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0)).alias("score")), ["tree", "node"])
    sums = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    return paths.join(ranked.where(F.col("rank") <= top).select("tree", "leaf", "rank"), ["tree", "leaf"])


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): each path as one conversation, root first.

    A turn is TURN, role, BODY, text, END, with role and text escaped; nulls are empty. loss lists start and
    length, in characters of `formatted`, of the assistant's texts.
    """
    turns = paths.join(nodes.select("tree", "node", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")), ["tree", "node"])
    row = F.struct((-F.col("up")).alias("at"), "role", "text")
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(BODY), t["text"], F.lit(END))), "")
    head, tail = len(TURN) + len(BODY), len(END)

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + head + F.length(t["role"])
        span = F.array(F.struct(start.alias("start"), F.length(t["text"]).alias("length")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((start + F.length(t["text"]) + tail).alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    return whole.select("tree", "leaf", "rank", shown.alias("formatted"), F.aggregate("turns", empty, add)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to rows of format_paths(): turns (array of role, text), parsed, and loss_text, the unescaped text under the mask."""
    parts = F.split("formatted", r"<\|end\|>", -1)
    body = F.slice(parts, 1, F.size(parts) - 1)

    def parse(part: Column) -> Column:
        pair = F.split(F.substr(part, F.lit(len(TURN) + 1)), r"<\|text\|>", -1)
        return F.struct(unescape(pair[0]).alias("role"), unescape(pair[1]).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": F.transform(body, parse), "loss_text": loss})


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text): one formatted conversation per conv_id, null included.

    The rows of a conversation are one thread in the order of turn (nulls first), role and text; each replies
    to the row before it, so repeated turns all appear. Output is written to the shared folder, and returned
    as read from there: conv_id, formatted, loss.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    nodes = nodes.withColumns({"parent": F.col("node") - 1, "score": F.length(F.coalesce("text", F.lit("")))})
    nodes = cut(nodes, "replies")
    made = format_paths(best_paths(nodes), nodes)
    names = F.when(F.col("tree") == "", F.lit(None)).otherwise(F.col("tree")).cast("long")
    return cut(made.select(names.alias("conv_id"), "formatted", "loss"), "chats")
