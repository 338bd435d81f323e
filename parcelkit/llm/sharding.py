"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into TICKETS equal arcs. Every shard owns ``vnodes`` tickets chosen by hash; a row's key hashes to a
place on the ring and belongs to the next owned ticket clockwise. A shard takes rows in ring order until its load
reaches the bound; the rest continue clockwise to the next virtual node whose shard still has room, round by round.
All decisions are made on the sums of a ticket (TICKETS rows at most, whatever the input); only rows of the one ticket
in which a shard fills up are ordered one by one, so no task ever holds a whole shard. A ticket that holds more than a
thousandth of all rows (one key may hold a third of them) is cut into PARTS by a hash of the row, and sums of parts decide in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Arcs of the ring; bounds the tables that are joined by broadcast (two numbers a row).
TICKETS = 65_536
#: Parts of a crowded ticket, and the share of all rows from which on it is one: at most 1,000 tickets are.
PARTS, CROWDED = 1024, 0.001


def _ring(spark, shards: int, vnodes: int, seed: int, full: list[int]) -> DataFrame:
    """(ticket, shard): the owner of each ticket among the shards that are not full. A fixed TICKETS rows."""
    nodes = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(TICKETS)).alias("ticket"))
    if full:
        nodes = nodes.where(~F.col("shard").isin(full))
    nodes = nodes.groupBy("ticket").agg(F.min("shard").alias("shard"))
    ring = spark.range(TICKETS).select(F.col("id").alias("ticket")).join(F.broadcast(nodes), "ticket", "left")
    after = Window.orderBy(F.desc("ticket")).rowsBetween(Window.unboundedPreceding, 0)  # the nearest owner from here on
    first = nodes.agg(F.min_by("shard", "ticket").alias("first"))  # one row: past the last owner the ring begins again
    return ring.crossJoin(F.broadcast(first)).select("ticket", F.coalesce(F.last("shard", True).over(after), "first").alias("shard"))


def bounded_ring(df: DataFrame, key: str, size: str, shards: int, slack: float = 0.01, vnodes: int = 64, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A shard stops taking rows once its load reaches (1 + slack) times the mean, so no shard exceeds that by more than
    one row. The key and the loads decide; a key that is null hashes like any value. Rows with the same key share a
    place on the ring, in order of their size and a hash of the row, but are split between shards when the bound demands it; only rows alike in
    all that may change places, which changes nothing. Null sizes count 0. An empty table gives
    an empty result; columns of ``df`` are kept, but those named shard and slot are replaced.
    """
    spark = df.sparkSession
    place = F.xxhash64(F.lit(seed), F.col(key))
    own = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.xxhash64(*own)
    packed = df.select(F.struct(*own).alias("_ring_row"), place.alias("_ring_at"), F.pmod(F.shiftright(place, 20), F.lit(TICKETS)).alias("_ring_ticket"), row.alias("_ring_hash"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_ring_size"))
    first = written(packed, "ring")
    rows, total = first.agg(F.count("*"), F.sum("_ring_size")).head()
    crowded = [r[0] for r in first.groupBy("_ring_ticket").count().where(F.col("count") > max(PARTS, CROWDED * rows)).select("_ring_ticket").collect()]  # 1 / CROWDED numbers at most
    part = F.when(F.col("_ring_ticket").isin(crowded), F.pmod(F.xxhash64("_ring_hash", "_ring_size"), F.lit(PARTS)).cast("int")).otherwise(0) if crowded else F.lit(0)
    left = first.withColumn("_ring_part", part)
    order = ["_ring_at", "_ring_size", "_ring_hash"]
    bound = max(1, -(-int((total or 0) * (1 + slack)) // shards))
    loads, placed, rounds, made = dict.fromkeys(range(shards), 0), [], 0, first
    while rows:
        full = [s for s, x in loads.items() if x >= bound]
        ring = _ring(spark, shards, vnodes, seed, full if len(full) < shards else [])
        had = F.create_map(*[F.lit(x) for s, x in loads.items() for x in (s, x)])
        sums = left.groupBy(F.col("_ring_ticket").alias("ticket")).agg(F.sum("_ring_size").alias("bytes"))
        # tickets of a shard in ring order, from the start of the ring; a fixed number of rows
        upto = Window.partitionBy("shard").orderBy("ticket").rowsBetween(Window.unboundedPreceding, -1)
        plan = sums.join(F.broadcast(ring), "ticket").withColumn("before", F.coalesce(F.sum("bytes").over(upto), F.lit(0)) + had[F.col("shard")])
        plan = plan.where(F.col("before") < bound).select(F.col("ticket").alias("_ring_ticket"), F.col("shard").alias("shard"), "before", (F.col("before") + F.col("bytes") <= bound).alias("fits"))
        dealt = left.join(F.broadcast(plan), "_ring_ticket", "left")
        # of tickets that do not fit, one for each shard, the parts in their order; rows one by one only in the part in which the shard fills up
        parts = dealt.where("not fits").groupBy("_ring_ticket", "_ring_part").agg(F.sum("_ring_size").alias("bytes"))
        earlier = Window.partitionBy("_ring_ticket").orderBy("_ring_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("_ring_ticket", "_ring_part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_ring_skip"))  # shards * PARTS rows at most
        inside = Window.partitionBy("_ring_ticket", "_ring_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        split = dealt.where("not fits").withColumn("before", F.col("before") + F.coalesce(F.sum("_ring_size").over(inside), F.lit(0)))
        split = split.join(F.broadcast(parts), ["_ring_ticket", "_ring_part"]).withColumn("before", F.col("before") + F.col("_ring_skip")).drop("_ring_skip")
        split = split.withColumn("shard", F.when(F.col("before") < bound, F.col("shard")))
        dealt = written(dealt.where("fits is null or fits").unionByName(split).drop("before", "fits"), "ring")
        forget(made)
        made = dealt
        taken = dealt.where("shard is not null").withColumn("_ring_round", F.lit(rounds))
        placed.append(taken)
        for s, x in taken.groupBy("shard").agg(F.sum("_ring_size")).collect():  # one number for each shard
            loads[s] += x
        left = dealt.where("shard is null").drop("shard")
        rows, rounds = left.count(), rounds + 1
        made = left = written(left, "ring") if rows else left
    if not placed:
        return df.select(*own).limit(0).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    by = ["shard", "_ring_ticket", "_ring_part"]
    counts = out.groupBy(*by).agg(F.count("*").alias("_ring_n"))
    upto = Window.partitionBy("shard").orderBy("_ring_ticket", "_ring_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, F.coalesce(F.sum("_ring_n").over(upto), F.lit(0)).alias("_ring_first"))
    # the join deals rows out as the window has
    out = out.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).join(first.hint("shuffle_hash"), by).withColumn("slot", F.col("slot") + F.col("_ring_first"))
    return out.select("_ring_row.*", "shard", F.col("slot").cast("long").alias("slot"))
