"""Chat formatting of reply trees, with DataFrame operations only.

Nodes point to their parents. Self-joins double the pointers' reach each round:
they find every node's root and depth and the summed score of its path from the
root, in a number of rounds that grows with the logarithm of the depth. A path's
score is its mean node score; each tree's best paths are chosen, walked back to
the root by the same pointers, and formatted as one conversation each.

A turn is ``<s>role``, a line feed, the text and ``</s>``. A control string inside
a role or text gets a backslash after its first character, and one more if it has
some there already, so no text holds a control string and the original is got back
by taking one away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: The template's own marks and those of other usual templates, less the first character.
_TAILS = r"(/?s>|/?INST\]|/?SYS>>|\|im_(?:start|end)\|>|\|endoftext\|>)"
_CONTROL = r"([<\[])(\\*)" + _TAILS
_ESCAPED = r"([<\[])\\(\\*)" + _TAILS
OPEN, CLOSE = "<s>", "</s>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role on one line: backslash and line feed as \\\\s and \\\\n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def reply_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of each tree.

    ``nodes`` is (tree, node bigint, parent bigint, score double); ``node`` is unique
    in the frame and a parent that is null or missing makes a root. Returns tree,
    path (the leaf's node), path_score, path_rank, node and step from 0 at the root.
    A path's score is the mean of its nodes' scores, null ones counting 0; ties go to
    the smaller leaf. Nodes on a cycle have no root and are on no path.
    """
    base = nodes.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    own = base.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    # up: the ancestor that the pointer reaches, null past the root; gap: steps covered; total: their scores.
    start = base.join(own, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("gap"), F.col("score").alias("total"))
    level = cut(start)
    pointers, ended = [level.where("up is not null").select("node", "up")], [level.where("up is null")]
    bound = 2 * max(1, nodes.count()).bit_length()
    while not (live := level.where("up is not null")).isEmpty() and len(pointers) <= bound:
        done = reduce(DataFrame.unionAll, ended).select(F.col("node").alias("up"), F.lit(None).cast("bigint").alias("next"), F.col("gap").alias("more"), F.col("total").alias("plus"))
        ahead = live.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("gap").alias("more"), F.col("total").alias("plus"))
        level = cut(live.join(done.unionAll(ahead), "up").select("node", F.col("next").alias("up"), (F.col("gap") + F.col("more")).alias("gap"), (F.col("total") + F.col("plus")).alias("total")))
        pointers.append(level.where("up is not null").select("node", "up"))
        ended.append(level.where("up is null"))
    rooted = cut(reduce(DataFrame.unionAll, ended))
    leaves = nodes.select("tree", "node").join(base.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    scored = leaves.join(rooted, "node").select("tree", F.col("node").alias("path"), (F.col("total") / F.col("gap")).alias("path_score"), (F.col("gap") - 1).alias("depth"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "path"))
    chosen = cut(scored.withColumn("path_rank", rank).where(F.col("path_rank") <= keep))
    # Each chosen leaf and, pointer level by level from the longest reach, the ancestors that its path still lacks.
    walk = chosen.select("path", F.col("path").alias("node"))
    for hop in reversed(pointers[:-1] if len(pointers) > 1 else pointers):
        # Cut off each time, as the plan holds the walk so far twice.
        walk = cut(walk.unionAll(walk.join(hop, "node").select("path", F.col("up").alias("node"))))
    on_path = walk.join(rooted.select("node", (F.col("gap") - 1).alias("step")), "node")
    return chosen.join(on_path, "path").select("tree", "path", "path_score", "path_rank", "node", "step")


def format_paths(turns: DataFrame) -> DataFrame:
    """One formatted conversation for each ``path``.

    ``turns`` is (path, step, role, text); a null role or text counts as empty.
    Returns path, n_turns, formatted and loss: the array of (start, end) in code
    points of the assistant turns' texts in ``formatted``, which make the loss mask.
    """
    role, text = _role_out(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    said = turns.select("path", F.struct("step", F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss")).alias("t"))
    got = said.groupBy("path").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    close = F.lit(CLOSE)
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], close)))
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return got.select("path", F.size("turns").cast("bigint").alias("n_turns"), formatted.alias("formatted"), ends["spans"].alias("loss"))


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    bare = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(bare, lambda p: F.struct(_role_in(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def conversation_nodes(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: (tree, node, parent, score, role, text).

    Rows of a conversation are ordered by turn, then role and text, nulls first;
    each answers the one before. Rows with a null conversation id form one tree.
    The nodes are written once, as their numbers must be the same in every use.
    """
    rows = df.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), "role", "text").withColumn("node", F.monotonically_increasing_id())
    before = F.lag("node").over(Window.partitionBy("tree").orderBy("turn", "role", "text", "node"))
    return cut(rows.select("tree", "node", before.alias("parent"), F.lit(0.0).alias("score"), "role", "text"))
