"""Chat formatting: reply trees, branch ranking and a reversible template.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The template: TURN role newline text END.  Texts and roles cannot hold "<", so neither mark can occur in them.
TURN, END = "<|turn|>", "<|end|>"
#: Escapes, each a backslash and a letter; the backslash is escaped first and restored last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def branches(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths of the reply trees in messages (node, parent).

    Returns (leaf, node, up): node lies ``up`` replies above leaf.  Self-joins double the
    distance each time, so a depth d takes log2(d) of them.  A parent that does not exist
    makes its child a root.  Raises ValueError where replies form a circle.
    """
    tree = messages.select("node", "parent")
    known = tree.select(F.col("node").alias("parent")).distinct()
    jumps = materialize(tree.join(known, "parent").select("node", F.col("parent").alias("above")), "jumps")
    leaves = tree.join(tree.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node")
    paths = materialize(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    longest = jumps.count()
    step = 1
    while not jumps.isEmpty():
        if step > longest:
            raise ValueError("replies form a circle")
        further = paths.join(jumps, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        paths = materialize(paths.unionByName(further), "paths")
        next_jump = jumps.select(F.col("node").alias("above"), F.col("above").alias("beyond"))
        jumps = materialize(jumps.join(next_jump, "above").select("node", F.col("beyond").alias("above")), "jumps")
        step *= 2
    return paths


def best_branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, up) of the best branches of each tree, by the sum of their scores; ties go to the smaller leaf."""
    paths = branches(messages)
    scored = paths.join(messages.select("node", "tree", "score"), "node")
    totals = scored.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    chosen = totals.withColumn("rank", rank).where(F.col("rank") <= per_tree).select("leaf")
    return scored.join(chosen, "leaf").select("tree", "leaf", "node", "up")


def format_branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """Formats the best branches of reply trees, each as one conversation.

    messages: tree, node (unique), parent (null for a root), role, text, score.
    Returns (tree, leaf, formatted, loss): loss holds the [start, end) code points of each
    assistant text.  Null texts and roles are empty; an empty table gives an empty result.
    """
    path = best_branches(messages, per_tree).join(messages.select("node", "role", "text"), "node")
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit("\n"))
    turns = path.select("tree", "leaf", "role", (-F.col("up")).alias("at"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    ahead = F.sum(F.length("piece")).over(Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(ahead, F.lit(0)) + F.length("head"))
    turn = F.struct("at", "piece", (F.col("role") == "assistant").alias("scored"), "start", (F.col("start") + F.length("body")).alias("end"))
    whole = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree",
        "leaf",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["scored"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss"),
    )


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as reply trees: each row answers the row before it.

    Rows of one turn follow each other by role and text, so repeated rows stay turns of their
    own.  Rows without a conv_id form one conversation.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "role", "text", key.alias("key"), place.alias("place"))
    name = lambda n: F.concat_ws(":", "key", F.lpad(n.cast("string"), 12, "0"))
    return rows.select(
        F.col("conv_id").alias("tree"),
        name(F.col("place")).alias("node"),
        F.when(F.col("place") > 1, name(F.col("place") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of conversations (conv_id, turn, role, text)."""
    rows = materialize(conversation_tree(conversations), "messages")
    return format_branches(rows).select(F.col("tree").alias("conv_id"), "formatted", "loss")


def parse(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: adds turns, an array of (role, text), and loss_text."""
    parts = F.slice(F.split("formatted", F.lit(END.replace("|", "\\|"))), F.lit(1), F.size(F.split("formatted", F.lit(END.replace("|", "\\|")))) - 1)

    def turn(p: Column) -> Column:
        p = F.substr(p, F.lit(len(TURN) + 1))
        cut = F.instr(p, F.lit("\n"))
        return F.struct(unescape(F.substr(p, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"), unescape(F.substr(p, cut + 1)).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(loss, ""))
