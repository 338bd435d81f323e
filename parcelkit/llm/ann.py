"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

Every tree halves the vectors again and again near the median of a random projection, until leaves hold about
LEAF_ROWS; the depth follows the number of vectors. Medians come from a bounded sample, every vector is dropped down
every tree. A query keeps one priority queue for all trees: it holds the parts of trees that it has not entered,
ordered by the sum of squared distances to the splits on whose other side they lie, and gives out leaves until that sum
exceeds ``reach``. The vectors of these leaves are the candidates, ranked by the exact measure.

``reach`` is measured, not set: for a bounded number of the queries the true neighbours are found exactly in one pass
over all vectors, and the queue reaches as far as the wanted share of them needs. So recall holds at every size, and
the share of vectors looked at falls as trees grow deeper.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a leaf; of a group of neighbouring leaves, which one task call holds; bytes of the sample that fits the trees; queries that measure ``reach``.
LEAF_ROWS, GROUP_ROWS, SAMPLE_BYTES, MEASURED = 12, 4096, 16 << 20, 128


class Forest:
    """Split lines and cuts of ``trees`` trees of ``depth`` levels, fitted on ``sample`` (unit vectors).

    A level has a cut for each node as long as nodes hold 8 vectors of the sample; deeper levels have one cut each, the
    line's median, so the size of a forest is bounded by its sample however deep it is.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int) -> None:
        self.depth, self.lines = depth, np.random.default_rng(seed).standard_normal((trees, depth, sample.shape[1]))
        self.fitted = min(depth, max(0, int(math.log2(max(1, len(sample) / 8)))))
        self.cuts, self.late = np.zeros((trees, 2**self.fitted - 1)), np.zeros((trees, depth))
        for t in range(trees):
            values = sample @ self.lines[t].T
            self.late[t] = np.median(values, axis=0)
            node = np.zeros(len(sample), np.int64)
            for level in range(self.fitted):
                order = np.lexsort((values[:, level], node))
                ends = np.searchsorted(node[order], np.arange(2**level + 1))
                for k in range(2**level):
                    inside = values[order[ends[k] : ends[k + 1]], level]
                    self.cuts[t, 2**level - 1 + k] = np.median(inside) if len(inside) else self.late[t, level]
                node = 2 * node + (values[:, level] > self.cuts[t, 2**level - 1 + node])

    def cut(self, t: int, level: int, node):
        """The cut of a node, or of an array of nodes."""
        return self.cuts[t, 2**level - 1 + node] if level < self.fitted else self.late[t, level]

    def leaf(self, x: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        values = x @ self.lines[t].T
        for level in range(self.depth):
            node = 2 * node + (values[:, level] > self.cut(t, level, node))
        return node

    def search(self, q: np.ndarray, reach: float) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one shared queue gives out for the query ``q`` up to ``reach``."""
        values = self.lines @ q
        queue = [(0.0, t, 0, 0) for t in range(len(self.lines))]
        found: list[tuple[int, int]] = []
        while queue and queue[0][0] <= reach:
            beyond, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = float(values[t, level] - self.cut(t, level, node))
                near = int(margin > 0)
                if (other := beyond + margin * margin) <= reach:
                    heapq.heappush(queue, (other, t, level + 1, 2 * node + 1 - near))
                level, node = level + 1, 2 * node + near
            found.append((t, node))
        return found

    def away(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How far the queue must reach from ``q`` to give out a leaf that holds each row of ``x``."""
        best = np.full(len(x), np.inf)
        for t in range(len(self.lines)):
            mine, values = self.lines[t] @ q, x @ self.lines[t].T
            node, beyond = np.zeros(len(x), np.int64), np.zeros(len(x))
            for level in range(self.depth):
                cut = self.cut(t, level, node)
                side = values[:, level] > cut
                beyond += np.where(side == (mine[level] > cut), 0.0, (mine[level] - cut) ** 2)
                node = 2 * node + side
            best = np.minimum(best, beyond)
        return best


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; exact, so cosines stay what they are."""
    x = np.asarray(vectors, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = _scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row with its partner, in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _largest(group: np.ndarray, score: np.ndarray, n: int, slack: float = 1e-9) -> np.ndarray:
    """Places of the ``n`` largest scores of each group, and of all within ``slack`` of the last one."""
    order = np.lexsort((-score, group))
    g, s = group[order], score[order]
    first = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(g)))
    last = s[begin + np.minimum(n, size) - 1]
    return order[s >= np.repeat(last - slack, size)]


def _ranked(query: np.ndarray, q: np.ndarray, base: pd.DataFrame, raw: np.ndarray, qi: np.ndarray, bi: np.ndarray, k: int) -> pd.DataFrame:
    """Exact scores of the pairs (row of ``q``, row of ``raw``); the ``k`` best ids of each query."""
    exact = _cosines(q[qi], raw[bi]) if len(qi) else np.zeros(0)
    lists = [base["ids"].iloc[i] for i in bi]
    n = np.array([len(x) for x in lists], np.int64)
    ids = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    own, score, who = np.repeat(query[qi], n), np.repeat(exact, n), np.repeat(qi, n)
    other = ids != own
    own, score, who, ids = own[other], score[other], who[other], ids[other]
    order = np.lexsort((ids, -score, who))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(who[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    best = order[nth < k]
    return pd.DataFrame({"query_id": own[best], "vec_id": ids[best], "score": score[best]})


def nearest(
    df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    trees: int = 8, recall: float = 0.95, reach: float | None = None, seed: int = 5,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the ``k`` nearest rows found for each row with ``is_query``.

    Nearness is the cosine in double precision, ties go to the smaller id, the query's own id is no candidate; fewer
    rows than ``k`` come back only if there are fewer candidates. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, take no part. Vectors are candidates of queries of their own length
    only; each length has its own forest. Repeated rows with one id count once; an id with different vectors is the query or
    candidate of each. Equal vectors are indexed once, with
    their k + 1 smallest ids (the query's own may be one). The trees are fitted on a sample of at most SAMPLE_ROWS bytes, chosen by hash; every
    vector is indexed. ``reach`` is measured on at most MEASURED queries, chosen by hash, for a share ``recall`` of their
    true neighbours, unless given. A null ``is_query`` is false. An empty table gives an empty result. Other columns are ignored.
    """
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if kind == "float" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    whole = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = written(rows.where(whole).withColumn("h", F.md5(F.to_json(F.struct("v")))), "vectors")
    first = rows.select("h", "id").distinct().withColumn("at", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("at") <= k + 1)
    classes = first.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(rows.groupBy("h").agg(F.first("v").alias("v")), "h")
    classes = written(classes, "classes")
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row for each length
    queries = rows.where("q").dropDuplicates(["id", "h"]).select("id", "h", "v")
    found = [_search(classes.where(F.size("v") == d), queries.where(F.size("v") == d), kind, d, n, k, trees, recall, reach, seed) for d, n in sorted(dims.items())]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def true_neighbours(classes: DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, v): the ``k`` + 1 nearest vectors of each of the few ``asked`` ones, in one pass over all vectors; query is the row in ``asked``."""
    q = classes.sparkSession.sparkContext.broadcast(_unit(np.stack(asked["v"])))
    vectors = classes.schema["v"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            near = q.value @ _unit(np.stack(pdf["v"])).T
            query, at = np.divmod(np.arange(near.size), near.shape[1])
            some = _largest(query, near.ravel(), k + 1, 0.0)
            new = pd.DataFrame({"query": query[some], "score": near.ravel()[some], "v": pdf["v"].iloc[at[some]].to_numpy()})
            best = new if best is None else pd.concat([best, new], ignore_index=True)
            best = best.iloc[_largest(best["query"].to_numpy(), best["score"].to_numpy(), k + 1, 0.0)[: (k + 1) * len(q.value)]]
        if best is not None:
            yield best

    top = classes.select("v").mapInPandas(scan, f"query long, score double, v {vectors}")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return top.withColumn("n", rank).where(F.col("n") <= k + 1).select("query", "v").toPandas()  # MEASURED * (k + 1) rows


def _search(classes: DataFrame, queries: DataFrame, kind: str, dim: int, n: int, k: int, trees: int, recall: float, reach: float | None, seed: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best that each group of leaves holds for each query; ``n`` vectors of length ``dim``."""
    spark = classes.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = classes.orderBy(F.xxhash64("h")).limit(max(256, SAMPLE_BYTES // (8 * dim))).select("v").toPandas()
    sample = _unit(np.stack(sample["v"]))
    built = Forest(sample, trees, max(0, math.ceil(math.log2(n / LEAF_ROWS))) if n > LEAF_ROWS else 0, seed)
    if reach is None:
        some = queries.orderBy(F.xxhash64("h", "id")).limit(MEASURED).select("v").toPandas()
        if some.empty:
            return spark.createDataFrame([], FOUND)
        true = true_neighbours(classes, some, k)
        q = _unit(np.stack(some["v"]))
        away = [built.away(q[i], _unit(np.stack(part))) for i, part in true.groupby("query")["v"]]
        reach = float(np.quantile(np.concatenate(away), recall))
    forest = spark.sparkContext.broadcast(built)
    # leaves are grouped by their first ``coarse`` levels; what the sample shows to be crowded is dealt to several tasks
    coarse = min(built.fitted, max(0, math.ceil(math.log2(n / GROUP_ROWS)))) if n > GROUP_ROWS else 0
    shift = built.depth - coarse
    held = [np.bincount(built.leaf(sample, t) >> shift, minlength=2**coarse) for t in range(trees)]
    parts = np.maximum(1, np.ceil(np.array(held) / len(sample) * n / (2 * GROUP_ROWS)).astype(np.int64))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, salt = _unit(np.stack(pdf["v"])), pdf["salt"].to_numpy()
            for t in range(trees):
                leaf = forest.value.leaf(x, t)
                yield pd.DataFrame({"t": t, "top": leaf >> shift, "part": salt % parts[t][leaf >> shift], "leaf": leaf, "ids": pdf["ids"], "v": pdf["v"]})

    def ask(batches: Iterator[pd.DataFrame], reach: float) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, v in zip(pdf["id"], pdf["v"], strict=True):
                chosen = pd.DataFrame(forest.value.search(_unit(v[None, :])[0], reach), columns=["t", "leaf"])
                chosen = chosen.groupby(["t", chosen["leaf"] // 2**shift])["leaf"].agg(list).rename("leaves").rename_axis(["t", "top"]).reset_index()
                many = parts[chosen["t"], chosen["top"]]
                chosen = chosen.loc[np.repeat(np.arange(len(chosen)), many)].assign(id=own, part=np.concatenate([np.arange(m) for m in many]))
                yield chosen.assign(v=[v] * len(chosen))

    def rank(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or base.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        base = base.sort_values("leaf", kind="stable")
        raw, q = np.stack(base["v"]), np.stack(queries["v"])
        x, u = _unit(raw), _unit(q)
        leaves, begin = np.unique(base["leaf"].to_numpy(), return_index=True)
        end = np.append(begin[1:], len(base))
        wanted = np.concatenate(queries["leaves"].to_list())
        who = np.repeat(np.arange(len(queries)), queries["leaves"].map(len))
        at = np.minimum(np.searchsorted(leaves, wanted), len(leaves) - 1)
        order = np.flatnonzero(leaves[at] == wanted)
        order = order[np.argsort(at[order], kind="stable")]
        who, at = who[order], at[order]
        qi, bi, near = [], [], []
        for s, z in zip(c := np.flatnonzero(np.diff(at, prepend=-1)), np.append(c[1:], len(at)), strict=True):
            lo, hi = begin[at[s]], end[at[s]]
            for a in range(s, z, 1024):
                asks = who[a : min(a + 1024, z)]
                score = (u[asks] @ x[lo:hi].T).ravel()
                of, row = np.divmod(np.arange(len(score)), hi - lo)
                some = _largest(of, score, k + 1) if hi - lo > k + 1 else np.arange(len(score))
                qi.append(asks[of[some]])
                bi.append(lo + row[some])
                near.append(score[some])
        if not qi:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qi, bi, near = map(np.concatenate, (qi, bi, near))
        some = _largest(qi, near, k + 1)
        return _ranked(queries["id"].to_numpy(), q, base, raw, qi[some], bi[some], k)

    indexed = classes.select("ids", "v", F.pmod(F.xxhash64("h"), F.lit(2**31)).alias("salt")).mapInPandas(index, f"t int, top long, part long, leaf long, ids array<long>, v {kind}")
    by = ["t", "top", "part"]

    def answered(queries: DataFrame, reach: float) -> DataFrame:
        # one row a query: a fixed number of partitions, which are not put together again because rows are few
        asked = queries.select("id", "v").repartition(parallel, "id").mapInPandas(lambda batches: ask(batches, reach), f"t int, top long, leaves array<long>, id long, part long, v {kind}")
        best = asked.groupBy(*by).cogroup(indexed.groupBy(*by)).applyInPandas(rank, FOUND)
        return written(best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")

    best = answered(queries, reach)
    full = best.groupBy("query_id").count().where(F.col("count") >= k)
    short = written(queries.join(full.select(F.col("query_id").alias("id")).hint("shuffle_hash"), "id", "left_anti"), "short")
    if not short.isEmpty() and not math.isinf(reach):  # leaves with fewer than k vectors: these queries enter every leaf
        best = best.union(answered(short, math.inf))
    return best
