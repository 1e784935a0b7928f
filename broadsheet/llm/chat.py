"""Chat formatting from reply trees, with DataFrame functions only.

Turns are nodes that name the turn they answer. Self-joins that double their
reach each time tell every node its root, depth and the score of its path; the
leaves of a tree are ranked by that score, and each chosen leaf's path is walked
back by the same jumps, halving the stretch each time. So a path of n turns costs
log n joins. Every chosen path becomes one formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stays on its line: backslash and line end become ``\\b`` and ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle: no side of a self-join goes through the driver."""
    return left.join(right.hint("merge"), on, how)


def chosen_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """``tree, node, parent, score`` -> ``tree, leaf, node``: the nodes of the chosen
    root-to-leaf paths.

    ``(tree, node)`` is unique and not null. A parent that is null or not there
    makes a root; a node on a cycle has no root and is left out. Leaves of a tree
    rank by the sum of scores on their path (null: 0), then the longer path, then
    the smaller leaf; the first ``per_tree`` stay (None: all).
    """
    # A stretch of `steps` nodes from `node` upwards ends below `up`, which may turn
    # out not to be there: then the stretch ends at a root.
    jump = written(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"),
                                F.coalesce("score", F.lit(0.0)).cast("double").alias("sum")), "jump")
    jumps, reach, size = [jump.where("up is not null").select("tree", "node", "up")], 1, jump.count()
    while jumps[-1].limit(1).count() and reach <= size:
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"),
                            F.col("steps").alias("steps2"), F.col("sum").alias("sum2"))
        # Roots are done: only nodes whose stretch still ends below another node join.
        done, open_ = jump.where("up is null"), jump.where("up is not null")
        jump = written(done.unionByName(
            met(open_, above, ["tree", "up"], "left")
            .select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
                    (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"))), "jump")
        reach *= 2
        jumps.append(jump.where("up is not null").select("tree", "node", "up"))
    parents = jumps[0].select("tree", F.col("up").alias("node"))
    leaves = met(jump.where("up is null"), parents, ["tree", "node"], "left_anti")
    if per_tree is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("sum"), F.desc("steps"), "node")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree)
    # A stretch of `steps` nodes that ends in `node`; halved until all are single. Each
    # halving names the walk once, so the plan grows by one join a step.
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", "steps")
    for k in range(len(jumps) - 2, -1, -1):
        half = F.lit(1 << k).cast("long")
        upper = F.struct(F.col("up").alias("node"), (F.col("steps") - half).alias("steps"))
        halves = F.when(F.col("steps") > half, F.array(upper, F.struct("node", half.alias("steps")))).otherwise(F.array(F.struct("node", "steps")))
        walk = met(walk, jumps[k], ["tree", "node"], "left").select("tree", "leaf", F.explode(halves).alias("h")).select("tree", "leaf", "h.node", "h.steps")
        if k % 3 == 0:
            walk = written(walk, "walk")
    return walk.select("tree", "leaf", "node")


def format_trees(nodes: DataFrame, per_tree: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree, node, parent, depth_order, role, text, score`` -> one row for each
    chosen path: ``tree, leaf, formatted, loss`` (spans ``start, length`` of
    ``formatted``, in code points, from 0).

    ``depth_order`` sorts a path's nodes (a turn number; a child's is larger).
    Null roles and texts are empty. One conversation is one row and one string.
    """
    path = chosen_paths(nodes.select("tree", "node", "parent", "score"), per_tree)
    turns = met(path, nodes.select("tree", "node", "depth_order", F.coalesce("role", F.lit("")).alias("role"),
                                   F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    turns = (turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
             .withColumn("body", escape(F.col("text"))))
    turns = turns.withColumn("whole", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("tree", "leaf").orderBy("depth_order", "node").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("whole").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    both = F.sort_array(F.collect_list(F.struct("at", "whole", F.when(F.col("role") == loss_role, span).alias("span"))))
    got = turns.groupBy("tree", "leaf").agg(both.alias("both"))
    return got.select("tree", "leaf", F.array_join(F.transform("both", lambda t: t["whole"]), "").alias("formatted"),
                      F.filter(F.transform("both", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """``formatted`` -> array of ``role, text``, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        line = F.locate("\n", p)
        return F.struct(unescape_role(F.substring(p, F.lit(1), line - 1)).alias("role"),
                        unescape(F.substring(p, line + 1, F.length(p) - line - len(END) - 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as reply trees: every row answers the one
    before it in its conversation, by turn (null first), then role and text. A
    null conv_id is a conversation of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node")).select(
        F.struct("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.col("node").alias("depth_order"), "role", "text", F.lit(0.0).alias("score"))
