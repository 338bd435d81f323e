"""Chat formatting over reply trees, in DataFrame operations only.

Messages form trees. Iterative self-joins enumerate the paths from roots to leaves, twice as far each round; every
path is a branch, ranked before it is spelled out. Branches of a tree are ranked by the sum of their messages' scores, then by
length, then by the leaf's key; each chosen branch is formatted as one conversation.

Template of a turn:  ``<turn role>\\n`` text ``</turn>\\n``.  Texts escape ``\\``, ``<``, ``>`` and ``#`` as ``\\\\``, ``\\l``,
``\\g`` and ``\\h``, so no control string can appear inside one, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OPEN, MID, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), (">", "\\g")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    # \0 cannot stand after a backslash in escaped text, so it marks escaped backslashes meanwhile
    text = F.replace(text, F.lit("\\\\"), F.lit("\\0"))
    for a, b in (("\\l", "<"), ("\\h", "#"), ("\\g", ">"), ("\\0", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def linear_tree(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of flat conversations as a tree: (conv, node, parent, score, ...); each turn replies to the one before it.

    Turns that tie go by role, then text; null turns come first. Repeated rows stay, one after the other. A null conversation is one of its own.
    """
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    at = F.row_number().over(order).cast("long")
    return df.withColumn("node", at).withColumn("parent", F.when(at > 1, at - 1)).withColumn("score", F.lit(1.0))


def branches(tree: DataFrame, conv: str = "conv_id", best: int | None = 1) -> DataFrame:
    """(conv, branch, turns): the ``best`` root-to-leaf paths of each conversation, all if None.

    ``tree`` has conv, node, parent (null at a root), role, text and score. Null roles and texts are empty, null scores 0.
    turns is an array of structs (role, text) from the root. A parent that does not exist makes its reply a root; a
    message below or in a circle of replies is on no path from a root and is left out. Repeated (conv, node) rows
    keep the smallest (parent, role, text), null parents first. A null conv is a conversation of its own. Empty tables give
    empty results.

    A round of one self-join doubles how far each message sees: its ancestor at distance 2**k, and the sum of scores up to there. So a
    path of n messages takes log2(n) rounds of as many rows as there are messages. Only the chosen paths are spelled out then, by the
    same steps; texts come last.
    """
    nodes = tree.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("c"), F.col(conv).isNull().alias("no"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = nodes.groupBy("c", "no", "node").agg(F.min(F.struct(F.col("parent").isNotNull().alias("has"), "parent", "role", "text", "score")).alias("m")).select("c", "no", "node", "m.parent", "m.role", "m.text", "m.score")
    nodes = written(nodes, "nodes")
    one = ["c", "no"]
    most = nodes.groupBy(*one).count().agg(F.max("count")).head()[0] or 0
    known = nodes.select(*one, F.col("node").alias("parent"), F.col("node").alias("up"))
    seen = nodes.select(*one, "node", "parent", "score").join(known, [*one, "parent"], "left").select(*one, "node", "up", "score", F.lit(1).alias("length"))
    steps = [written(seen, "seen")]
    while 2 ** len(steps) <= 2 * most and not steps[-1].where("up is not null").isEmpty():
        last = steps[-1]
        above = last.select(*one, F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("length").alias("longer"))
        seen = last.join(above, [*one, "up"], "left").select(*one, "node", F.col("next").alias("up"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("length") + F.coalesce("longer", F.lit(0))).alias("length"))
        steps.append(written(seen, "seen"))
    inner = steps[0].where("up is not null").select(*one, F.col("up").alias("node")).distinct()
    leaves = steps[-1].where("up is null").join(inner, [*one, "node"], "left_anti")  # in or below a circle there is always something above
    rank = F.row_number().over(Window.partitionBy(*one).orderBy(F.desc("score"), F.desc("length"), "node"))
    paths = leaves.withColumn("branch", rank).select(*one, F.col("node").alias("leaf"), "branch")
    if best is not None:
        paths = paths.where(F.col("branch") <= best)
    paths = written(paths, "paths")
    reach = paths.select(*one, "branch", F.col("leaf").alias("node"), F.lit(0).alias("far"))
    for k, step in enumerate(steps[:-1]):
        up = step.where("up is not null").select(*one, "node", "up")
        reach = written(reach.union(reach.join(up, [*one, "node"]).select(*one, "branch", F.col("up").alias("node"), (F.col("far") + 2**k).alias("far"))), "reach")
    told = reach.join(nodes.select(*one, "node", "role", "text"), [*one, "node"])
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    told = told.groupBy(*one, "branch").agg(turns.alias("turns"))
    return told.select(F.when(~F.col("no"), F.col("c")).cast(tree.schema[conv].dataType).alias(conv), "branch", "turns")


def formatted(paths: DataFrame) -> DataFrame:
    """``paths`` with ``formatted``: the turns of each row in the template. No turns give an empty string."""
    turn = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID), escape(t["text"]), F.lit(CLOSE))
    return paths.withColumn("formatted", F.array_join(F.transform("turns", turn), ""))


def read_back(df: DataFrame, column: str = "formatted", answers: str = "assistant") -> DataFrame:
    """``df`` with what its formatted conversations say: ``turns_read`` (role, text, loss) and ``loss_text``.

    The loss mask covers the text of each ``answers`` turn, without its markers. A null conversation reads as null, an empty one as no turns.
    """
    body = F.filter(F.split(F.col(column), F.lit(CLOSE)), lambda x: x != "")
    part = lambda x: F.split(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), F.lit(MID), 2)
    turns = F.transform(body, lambda x: F.struct(unescape(part(x)[0]).alias("role"), unescape(part(x)[1]).alias("text"), (unescape(part(x)[0]) == answers).alias("loss")))
    out = df.withColumn("turns_read", turns)
    return out.withColumn("loss_text", F.array_join(F.transform(F.filter("turns_read", lambda t: t["loss"]), lambda t: t["text"]), ""))
