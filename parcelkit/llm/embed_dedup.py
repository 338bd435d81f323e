"""Near-duplicate vectors by collision-counting projections.

A vector is projected on many random lines. Two vectors collide on a line if one's value lies in the window around
the other's (query-centred). The number of lines on which a pair collides is binomial, so a pair is verified by its
exact cosine only if the count reaches a limit that a pair right at the threshold misses with a stated probability.

Counting over all pairs would be quadratic, so windows are searched only among vectors that share a coarse cell: each
of ``n_tables`` tables cuts ``n_lines`` of the sorted lines into wide intervals with a random shift. The number of
lines follows the number of vectors (cells keep their size), the number of tables follows from the recall asked for.
A pair that shares cells of several tables is handled in the first one only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .components import connected_components

#: Width of a coarse interval, in standard deviations of a projection of random unit vectors.
CELL_WIDTH = 1.5


def plan_tables(n: int, threshold: float, cell_rows: int = 300, miss: float = 0.003) -> tuple[int, int]:
    """(lines of a table, tables) for ``n`` vectors: cells of about ``cell_rows``, a pair at the threshold missed with probability ``miss``."""
    edges = np.arange(-9, 10) * CELL_WIDTH
    cdf = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in edges])
    same = float((np.diff(cdf) ** 2).sum())
    lines = max(1, round(math.log(n / cell_rows) / math.log(1 / same))) if n > cell_rows else 1
    step = math.sqrt(2 - 2 * threshold) * math.sqrt(2 / math.pi)
    stays = max(0.05, 1 - step / CELL_WIDTH) ** lines
    return lines, max(1, math.ceil(math.log(miss) / math.log(1 - stays)))


def plan_count(threshold: float, n_windows: int, miss: float = 0.001) -> tuple[float, int]:
    """(half width of a window, least count): a pair at the threshold counts fewer with probability ``miss`` at most."""
    half = 2 * math.sqrt(max(2 - 2 * threshold, 1e-12))
    p, below, least = math.erf(2 / math.sqrt(2)), 0.0, 0
    while (below := below + math.comb(n_windows, least) * p**least * (1 - p) ** (n_windows - least)) <= miss:
        least += 1
    return half, least


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collisions(pa: np.ndarray, pb: np.ndarray, half: float) -> np.ndarray:
    """Counts, for each row of ``pa`` and each of ``pb``, the lines on which b lies in a's window; each line of b is sorted once."""
    count = np.zeros((len(pa), len(pb)), np.uint8)
    for j in range(pa.shape[1]):
        order = np.argsort(pb[:, j], kind="stable")
        rank = np.empty(len(pb), np.uint32)
        rank[order] = np.arange(len(pb), dtype=np.uint32)
        line = pb[order, j]
        lo = np.searchsorted(line, pa[:, j] - half, "left").astype(np.uint32)
        hi = np.searchsorted(line, pa[:, j] + half, "right").astype(np.uint32)
        count += (rank[None, :] - lo[:, None]) < (hi - lo)[:, None]  # unsigned: below lo wraps round
    return count


def _smallest_label(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches through the symmetric matrix ``linked``; labels are followed to their own labels, so long paths take few steps."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            return ids[order[label]]
        label = new


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    n_windows: int = 48, block_rows: int = 1024, seed: int = 11,
) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one per row of ``df``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows with a null
    id (component_id null, kept). Vectors of different length never link. Equal vectors are one class with a count, so
    a group of copies costs one row. Rows with the same id are one node of the graph, counted as often as they occur.
    A crowded cell is cut into blocks of ``block_rows`` and every pair of blocks is a task of its own; pairs are
    counted in the task, only counts and one label per vector leave it. Other columns of ``df`` are ignored.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold must lie in [0.5, 1)")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = written(rows.select("id", F.when(F.col("id").isNotNull() & whole, F.col("v")).alias("v")).select("id", "v", F.xxhash64("v").alias("h"), F.md5(F.to_json(F.struct("v"))).alias("h2")), "vectors")
    valid = keyed.where("v is not null")
    classes = written(valid.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    n_lines, n_tables = plan_tables(classes.count(), threshold)
    half, least = plan_count(threshold, n_windows)
    matrices: dict = {}

    def lines(dim: int) -> tuple:
        if dim not in matrices:
            r = np.random.default_rng([seed, dim])
            matrices[dim] = r.standard_normal((dim, n_tables * n_lines)), r.uniform(0, CELL_WIDTH, n_tables * n_lines), r.integers(1, 2**62, n_lines, dtype=np.int64) | 1, r.standard_normal((dim, n_windows))
        return matrices[dim]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                m, shift, mix, _ = lines(dim)
                # values of unit vectors are scaled to the spread that random ones have
                at = np.floor((_unit(np.stack(part["v"])) @ m + shift) / CELL_WIDTH).astype(np.int64).reshape(len(part), n_tables, n_lines)
                with np.errstate(over="ignore"):
                    key = (at * mix).sum(axis=2) * 1_000_003 + dim
                yield pd.DataFrame({"rep": part["rep"], "n": part["n"], "v": part["v"], "cells": list(key)})

    celled = classes.select("rep", "n", "v").mapInPandas(cells, "rep long, n long, v array<double>, cells array<long>")
    celled = written(celled, "cells")
    spread = celled.select("rep", F.posexplode("cells").alias("t", "cell"))
    full = spread.groupBy("t", "cell").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    at = celled.select("rep", "n", "v", "cells", F.posexplode("cells").alias("t", "cell")).join(full.hint("shuffle_hash"), ["t", "cell"])
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep", "v"), F.col("blocks")).cast("int"))
    at = at.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("t", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "n", "v", "cells", F.size("v").alias("dim"))

    def count_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        t, i, j = int(pdf["t"].iloc[0]), pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, ids, n, mine, keys = _unit(np.stack(pdf["v"])), pdf["rep"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["mine"].to_numpy(), np.stack(pdf["cells"])
        count = collisions(p := x @ lines(x.shape[1])[3], p, half)
        a, b = np.nonzero(np.triu(count >= least, 1))
        ok = ~(keys[a, :t] == keys[b, :t]).any(axis=1) if t else np.ones(len(a), bool)
        if i != j:
            ok &= mine[a] != mine[b]
        a, b = a[ok], b[ok]
        linked = np.zeros((len(x), len(x)), bool)
        for s in range(0, len(a), 100_000):
            u, w = a[s : s + 100_000], b[s : s + 100_000]
            near = (x[u] * x[w]).sum(axis=1) >= threshold
            linked[u[near], w[near]] = linked[w[near], u[near]] = True
        some = linked.any(axis=1)
        return pd.DataFrame({"rep": ids, "links": linked @ n, "root": _smallest_label(linked, ids)})[some]

    found = at.groupBy("t", "cell", "i", "j", "dim").applyInPandas(count_pairs, "rep long, links long, root long")
    found = written(found, "found")
    forget(celled)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "rep", "root").withColumnRenamed("id", "rep")
    per_class = classes.select("h", "h2", "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    out = keyed.select("id", "h", "h2", F.col("v").isNotNull().alias("whole")).join(per_class.withColumn("whole", F.lit(True)), ["h", "h2", "whole"], "left")
    component = F.coalesce("component_id", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("whole"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
