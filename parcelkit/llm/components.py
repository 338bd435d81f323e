"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every id in ``links``; component_id is the smallest id of its component.

    Every id has a fixed random priority (its hash). Each round hooks every node to the one of smallest priority among its
    neighbours and itself, follows three more hooks, and contracts the links to the nodes that are left. Nodes that hook to
    themselves are no neighbours of each other, and chains of falling random priorities are short, so a path loses half of its nodes or more each
    round whatever the order of its ids, and a star is gone after two: 10,000 nodes in a row take about 10 rounds. Rounds
    are put together from the last one back, which are ever smaller tables. Nothing goes to the driver but the question whether
    links are left. Null ids and links of an id with itself are ignored, repeated links count once; an empty table gives an empty table.
    """
    ends = lambda df, x, y: df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct()
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left = written(ends(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b), "links")
    rounds: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        both = left.union(left.select("v", "u"))
        hook = both.groupBy("u").agg(F.min(ranked("v")).alias("least")).select("u", F.least("least", ranked("u"))["id"].alias("p"))
        for _ in range(2):
            hook = hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p").select("u", F.col("pp").alias("p"))
        hook = written(hook, "hooks")
        rounds.append(hook)
        by_u = hook.select("u", F.col("p").alias("pu"))
        by_v = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = written(ends(left.join(by_u, "u").join(by_v, "v"), "pu", "pv"), "links")
        forget(left)
        left = rest
    root = rounds[-1].select(F.col("u").alias("id"), F.col("p").alias("root"))
    for hook in reversed(rounds[:-1]):
        root = hook.join(root, hook.p == root.id, "left").select(F.col("u").alias("id"), F.coalesce("root", "p").alias("root"))
    root = written(root, "roots")
    for x in [*rounds, left]:
        forget(x)
    least = root.groupBy("root").agg(F.min("id").alias("component_id"))
    out = written(root.join(least, "root").select("id", "component_id"), "components")
    forget(root)
    return out


def with_links(groups: DataFrame, more: DataFrame, a: str, b: str) -> DataFrame:
    """``groups`` (of :func:`connected_components`) after the links ``more``: only the components that these connect are contracted, not all links again.

    Ids that ``groups`` lacks are components of their own until then. Null ids are ignored; without links the groups stay as they are.
    """
    more = more.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    label = lambda x: groups.select(F.col("id").alias(x), F.col("component_id").alias(f"c{x}"))
    ends = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    merged = connected_components(ends, "ca", "cb").select(F.col("id").alias("old"), F.col("component_id").alias("new"))
    alone = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups.hint("merge"), "id", "left_anti")
    every = groups.select("id", "component_id").union(alone.select("id", F.col("id").alias("component_id")))
    return written(every.join(merged, every.component_id == merged.old, "left").select("id", F.coalesce("new", "component_id").alias("component_id")), "components")
