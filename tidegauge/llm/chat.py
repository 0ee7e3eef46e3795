"""Chat formatting of reply trees, in DataFrame expressions only.

Messages point to their parents. Iterated self-joins by doubling list, for each leaf, all its ancestors: after k rounds those
up to 2**k steps away, so a tree of depth d takes about log2(d) rounds and the rows made are the lengths of the paths. The
branches of a tree are ranked by score (mean score of the messages, then length, then leaf) and the best `top` are formatted,
one conversation each.

Template: a turn is `<|im_start|>` role line-feed text `<|im_end|>` line-feed. In roles and texts every backslash is doubled
and `<|` becomes `<\\|` (a line feed in a role: `<\\n|`), so control strings inside texts can't be taken for marks, and
`parse` gives back the very texts. The loss mask is a list of spans (start and length in code points of the formatted text),
one for each assistant text.

Defined results: null roles and texts count as empty and null scores as 0; messages without a tree or node id belong to no
conversation; of rows that repeat a node id one is kept (smallest parent, role, text); a message whose parent is absent is a
root; messages on a cycle have no root-to-leaf path; other columns are not read; an empty table gives an empty result.
A formatted conversation is one row, so one task holds the texts of one branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("<\\n|"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, dist (steps from leaf to node) for messages (tree, node, parent)."""
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = C.written(nodes.where("parent IS NOT NULL").join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent"), "up")
    inner = up.select("tree", F.col("parent").alias("node")).distinct()
    reach = C.written(nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist")), "reach")
    jump, step = up, 1
    # A path is shorter than the number of messages of its tree; only a cycle could go on.
    longest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    while step <= longest and not jump.isEmpty():
        far = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("parent").alias("node"), (F.col("dist") + step).alias("dist"))
        reach = C.written(reach.unionByName(far), "reach")
        again = jump.select("tree", F.col("node").alias("parent"), F.col("parent").alias("next"))
        jump = C.written(jump.join(again, ["tree", "parent"]).select("tree", "node", F.col("next").alias("parent")), "jump")
        step *= 2
    return reach


def conversations(messages: DataFrame, top: int = 1, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str | None = None) -> DataFrame:
    """tree, leaf, rank (1 is the best branch), score, formatted and loss (array of struct of start and length)."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    m = messages.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), score.alias("score"))
    m = m.where("tree IS NOT NULL AND node IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.col("parent").asc_nulls_last(), "role", "text", "score"))
    m = C.written(m.withColumn("nth", nth).where("nth = 1").drop("nth"), "messages")
    roots = m.join(m.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_anti").select("tree", "node")
    reach = C.written(paths(m).join(m.select("tree", "node", "score"), ["tree", "node"]), "paths")
    whole = reach.join(roots.withColumn("root", F.lit(1)), ["tree", "node"], "left").groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("size"), F.max("root").alias("root"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("size"), "leaf")
    whole = whole.where("root = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("tree", "leaf", "rank", F.col("score").alias("branch"))

    # Texts travel for the chosen branches only.
    turns = reach.drop("score").join(C.written(whole, "branches"), ["tree", "leaf"]).join(m.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.select("tree", "leaf", "rank", "branch", "dist", F.col("role").alias("plain"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    turns = turns.withColumn("turn", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")))
    before = F.sum(F.length("turn")).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("start", (F.coalesce(before, F.lit(0)) + len(START) + F.length("role") + 1).cast("long"))
    one = F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "turn", "start", F.length("text").cast("long").alias("length"), (F.col("plain") == "assistant").alias("loss"))))
    out = turns.groupBy("tree", "leaf", "rank").agg(F.first("branch").alias("score"), one.alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("tree", "leaf", "rank", "score", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct of role and text, unescaped."""
    marks = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.transform(F.slice(marks, F.lit(1), F.size(marks) - 1), lambda t: F.substring(t, len(START) + 1, 2_000_000_000))

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(t.substr(F.length(role) + 2, F.lit(2_000_000_000))).alias("text"))

    return F.transform(parts, turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))


def from_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (tree, node, parent, role, text) of linear conversations: the parent of a turn is the turn before it, by
    turn, role and text; repeated rows are turns of their own. Rows without a conversation belong to no tree and are left out."""
    rows = rows.where(F.col(conv_col).isNotNull())
    nth = F.row_number().over(Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), role_col, text_col))
    x = rows.select(F.col(conv_col).alias("tree"), nth.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return x.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")
