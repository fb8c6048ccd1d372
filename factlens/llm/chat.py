"""Chat formatting of reply trees.

Messages are nodes with a parent; iterative self-joins enumerate each leaf's
path to its root, doubling the reach in every round (the jump of 2^k parents
is joined with itself), so a path of n turns takes about log2(n) rounds.
Branches of a tree are ranked by their score (the sum over the path's
messages; ties by leaf) and each chosen path is written as one conversation:

    <|turn|>role<|text|>text<|end|>

for each turn.  Roles and texts are escaped: a backslash goes before every
backslash, and after the first character of every control string (those of
this template and the common ones of other chat formats); removing each
backslash and keeping the character behind it gives the text back.

Results: null roles and texts are empty.  A message whose parent is null,
itself or missing is a root; messages of a cycle have no path.  Messages that
repeat a node id are kept in turn order as replies to one another by
``threads``; ``paths`` asks for distinct ids.  Null conversation ids are one
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.llm.common import written

# fixed values: the control strings that may not stand in a formatted text
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = "|".join("\\Q" + c[0] + "\\E(?=\\Q" + c[1:] + "\\E)" for c in CONTROL)
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def threads(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of plain conversations as reply chains: each row answers the
    row before it (by turn, then role and text).  Columns tree, node, parent,
    score, role, text."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    n = F.row_number().over(order)
    return rows.select(F.col(conv).alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"),
                       F.lit(0.0).alias("score"), F.col(role).alias("role"), F.col(text).alias("text"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth): the messages of each root-to-leaf path, depth
    counted from the leaf."""
    links = messages.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"))
    known = links.select(F.col("tree").alias("_t"), F.col("node").alias("_p"))
    jump = written(links.join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_p")))
                   .select("tree", "node", "parent"), "jumps")
    answered = jump.select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    leaves = links.join(answered, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_p")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("depth"))
    reach = 1
    for _ in range(MAX_ROUNDS):
        if jump.isEmpty():
            return found
        step = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("parent").alias("_up"))
        far = found.join(step, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))) \
            .select("tree", "leaf", F.col("_up").alias("node"), (F.col("depth") + reach).alias("depth"))
        found = written(found.unionByName(far), "paths")
        jump = written(jump.join(step, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")))
                       .select("tree", "node", F.col("_up").alias("parent")), "jumps")
        reach *= 2
        # only a cycle keeps jumping once every path has its root
        if far.isEmpty():
            return found
    return found


def format_conversations(messages: DataFrame, keep: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row for each chosen path: tree, leaf, score, rank, ``formatted`` and
    ``loss`` (array of (start, end) in code points of ``formatted``: the texts
    of ``loss_role``).  ``keep``: paths for each tree, best score first."""
    p = paths(messages)
    m = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "score",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full = p.join(m, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turn = F.struct((-F.col("depth")).alias("at"), head.alias("head"), escape(F.col("text")).alias("body"),
                    (F.col("role") == loss_role).alias("loss"))
    convs = full.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    convs = convs.withColumn("rank", rank)
    if keep is not None:
        convs = convs.filter(F.col("rank") <= keep)
    # a running total of lengths gives each text's place
    sized = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["loss"], F.concat(s["loss"], F.array(F.struct(
                (s["at"] + F.length(t["head"])).alias("start"),
                (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(s["loss"]).alias("loss")))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return convs.select("tree", "leaf", "score", "rank", formatted.alias("formatted"), sized["loss"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    parts = F.filter(F.split(formatted, "\\Q" + END + "\\E"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescape(F.element_at(F.split(x, "\\Q" + TEXT + "\\E", 2), 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, nothing between its spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
