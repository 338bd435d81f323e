"""Near-duplicate documents by MinHash bands, with odd sketches to check candidates and full sets to confirm links.

Every document's distinct word shingles give MinHash samples; runs of samples (bands) are bucket keys. The samples are
also folded into an odd sketch: a bitmap in which each sample flips one bit, so the population count of the XOR of two
sketches tells how many samples differ, most precisely at high similarity. Documents with equal sets are one class from
the start. In each bucket, members are first compared with two of its members (hubs), and where a bucket spans several groups a few times more;
only where groups still differ then are their members compared with each other, block by block. Pairs that the sketches let through are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from .common import forget, written
from .components import connected_components, with_links

#: Bands and samples of a band: a pair at similarity 0.8 shares no band with probability 7e-5. Samples that the sketch
#: folds, those of the bands among them, and its words of 64 bits.
BANDS, ROWS, SAMPLES, SKETCH = 24, 5, 360, 24
#: Times that the groups of a bucket are compared with a member drawn anew, before members are compared with each other.
HUB_ROUNDS = 1
#: Rows of a block; any two blocks of documents that are compared each with each are a task.
BLOCK = 512
_R = np.random.default_rng(77)
_MUL = _R.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _R.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of non-empty sets of 64-bit hashes, one row for each."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        h = low * _MUL[k] + _ADD[k]
        h ^= h >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(h * _MUL[k - 1], first)
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Bitmaps of 64 * SKETCH bits; each sample flips the bit that its hash (with its number) names."""
    at = (th.mix(sample.astype(np.uint64) + (np.arange(sample.shape[1], dtype=np.uint64) << np.uint64(32))) >> np.uint64(20)) % np.uint64(64 * SKETCH)
    out = np.zeros((len(sample), SKETCH), np.uint64)
    rows = np.arange(len(sample))
    for k in range(sample.shape[1]):
        out[rows, (at[:, k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (at[:, k] & np.uint64(63))
    return out.view(np.int64)


def most_bits(similarity: float, sigmas: float = 4.0) -> int:
    """The count of differing sketch bits that pairs of ``similarity`` exceed with negligible probability."""
    k, n = SAMPLES, 64 * SKETCH
    differ = k * (1 - similarity) + sigmas * math.sqrt(k * similarity * (1 - similarity))
    odd = n / 2 * (1 - math.exp(-4 * differ / n))
    return math.ceil(odd + sigmas * math.sqrt(odd) / 2)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in th.buffers(batch.column("text")):
                sets = th.shingles(*th.words(data, offsets), width)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), SKETCH), np.int64)
                if len(some):
                    filled = [sets[i] for i in some]
                    first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                    every = np.concatenate(filled)
                    h1[some] = np.add.reduceat(th.mix(every), first).view(np.int64)
                    h2[some] = np.bitwise_xor.reduceat(th.mix(every * np.uint64(0xA0761D6478BD642F)), first).view(np.int64)
                    drawn = samples(filled)
                    key = np.zeros((len(some), BANDS), np.uint64)
                    for k in range(ROWS):
                        key = th.mix(key * np.uint64(31) + drawn[:, k : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(k))
                    bands[some], sketch[some] = key.view(np.int64), odd_sketch(drawn)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at.start, at.stop - at.start), pa.array(n), pa.array(h1), pa.array(h2), lists(bands), lists(sketch)], ["id", "n", "h1", "h2", "bands", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in th.buffers(batch.column("text")):
                sets = th.shingles(*th.words(data, offsets), width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at.start, at.stop - at.start), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "shingles"])

    return run


def _each_with_each(percent: int, limit: int):
    """Two blocks of documents: sketches of all pairs of different groups, full sets of those that pass, until a pair of groups is linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        split = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        bits, n, mine, ids = np.stack(pdf["sketch"]).view(np.uint64), pdf["n"].to_numpy(), pdf["mine"].to_numpy(), pdf["id"].to_list()
        group = pd.factorize(pdf["g"])[0]
        sets = [np.sort(x) for x in pdf["shingles"]]
        up = {g: g for g in set(group.tolist())}

        def root(g: int) -> int:
            while up[g] != g:
                up[g] = up[up[g]]
                g = up[g]
            return g

        out = []
        for a in range(len(ids) - 1):
            apart = np.bitwise_count(bits[a + 1 :] ^ bits[a]).sum(axis=1)
            ok = (apart <= limit) & (group[a + 1 :] != group[a]) & (100 * np.minimum(n[a + 1 :], n[a]) >= percent * np.maximum(n[a + 1 :], n[a]))
            if split:
                ok &= mine[a + 1 :] != mine[a]
            for b in (np.flatnonzero(ok) + a + 1)[np.argsort(apart[ok], kind="stable")]:
                if (x := root(int(group[a]))) != (y := root(int(group[b]))):
                    at = np.searchsorted(sets[b], sets[a])
                    at[at == len(sets[b])] = 0
                    shared = int((sets[b][at] == sets[a]).sum())
                    if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                        up[x] = y
                        out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one per row of ``docs``.

    A-Z count as a-z; words are runs of anything but space and \\t..\\r. A document's set holds its distinct
    ``width``-word shingles, the whole sequence if it has fewer words, nothing without words or text; documents are linked
    if 100 * intersection >= ``percent`` * union, empty sets with nothing. component_id is the smallest id reachable.
    Sets hold 64-bit hashes of the shingles. Null ids take no part (component_id null, kept); rows with the same id are one
    node. Empty tables give empty results, other columns are ignored. Whole texts count, and no bucket is cut.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profile = written(texts.mapInArrow(_profile(width), f"id {kind}, n long, h1 long, h2 long, bands array<long>, sketch array<long>"), "profiles")
    has = profile.where("n > 0 and id is not null")
    same = ["n", "h1", "h2"]
    reps = has.groupBy(*same).agg(F.min("id").alias("id"))
    own = has.select("id", *same).join(reps.withColumnRenamed("id", "rep"), same).select("id", "rep")
    own = written(own, "classes")
    rows = written(has.join(reps.hint("shuffle_hash"), [*same, "id"], "left_semi").dropDuplicates(["id", *same]).select("id", "n", "bands", "sketch"), "classes")
    spread = rows.select("id", F.posexplode("bands").alias("band", "key"))
    crowded = spread.groupBy("band", "key").agg(F.count("*").alias("rows"), F.min("id").alias("hub"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("hub2")).where("rows > 1")
    members = written(spread.join(crowded.hint("merge"), ["band", "key"]).select("id", "band", "key", "hub", "hub2"), "buckets")
    sketches = rows.select("id", "n", "sketch")
    limit = most_bits(percent / 100)
    bits = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    def sets_of(ids: DataFrame) -> DataFrame:
        some = texts.join(ids.hint("shuffle_hash"), "id", "left_semi")
        return written(some.mapInArrow(_sets(width), f"id {kind}, shingles array<long>"), "sets")

    def across(mixed: DataFrame) -> DataFrame:
        """Links (a, b) between members of different groups, all of a cluster of buckets against all, block by block."""
        clusters = connected_components(mixed, "id", "hub").withColumnRenamed("component_id", "cluster")
        there = mixed.select("id", "g").distinct().join(clusters, "id")
        blocks = there.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sets = sets_of(there.select("id"))
        there = there.join(blocks.hint("merge"), "cluster").join(sketches.hint("merge"), "id").join(sets.hint("merge"), "id")
        there = there.withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        there = there.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "g", "n", "sketch", "shingles")
        return written(there.groupBy("cluster", "i", "j").applyInPandas(_each_with_each(percent, limit), f"a {kind}, b {kind}"), "confirmed")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the sketches let through and the full sets confirm."""
        named = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        pairs = pairs.join(named("a"), "a").join(named("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = written(pairs.where(bits("sa", "sb") <= limit).select("a", "b"), "candidates")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
        shared = F.size(F.array_intersect("xa", "xb"))
        out = written(both.where(100 * shared >= percent * (F.size("xa") + F.size("xb") - shared)).select("a", "b").distinct(), "confirmed")
        forget(sets)
        return out

    to_hub = lambda hub: members.where(F.col("id") != F.col(hub)).select(F.col(hub).alias("a"), F.col("id").alias("b"))
    links = confirmed(to_hub("hub").union(to_hub("hub2")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    groups = connected_components(links, "a", "b")
    in_groups = lambda: members.join(groups, "id", "left").select("id", "band", "key", F.coalesce("component_id", "id").alias("g"))
    for k in range(HUB_ROUNDS + 1):
        placed = in_groups()
        drawn = F.min(F.struct(F.xxhash64("id", F.lit(k), "band"), "id", "g"))
        mixed = placed.groupBy("band", "key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), drawn.alias("hub")).where("lo < hi")
        mixed = placed.join(mixed.select("band", "key", "hub.id", "hub.g").toDF("band", "key", "hub", "hub_g").hint("shuffle_hash"), ["band", "key"])
        mixed = written(mixed, "mixed")
        if mixed.isEmpty():
            break
        if k < HUB_ROUNDS:
            pairs = mixed.where("g != hub_g").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
            more = confirmed(pairs.distinct().join(links, ["a", "b"], "left_anti"))
        else:
            more = across(mixed)
        if more.isEmpty():
            continue
        links = links.union(more)
        groups = with_links(groups, more, "a", "b")
    groups = groups.withColumnRenamed("id", "rep")
    found = own.distinct().join(groups, "rep", "left").select("id", F.coalesce("component_id", "rep").alias("component_id")).groupBy("id").agg(F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "id")
    return profile.select("id", "n").join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
