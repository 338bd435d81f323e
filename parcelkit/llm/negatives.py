"""Hard-negative mining by the threshold algorithm on per-dimension sorted lists.

Vectors become integers, so scores are exact. Candidates are dealt into blocks of bounded size; a block's task sorts its candidates
once by every dimension. An anchor walks all lists at once, each from the end that its own sign favours (sorted access),
and scores what it meets for the first time (random access). No row it has not met can score more than the threshold, the score of a
row made of the values where the lists now stand; an anchor stops as soon as the threshold lies strictly below the k-th score
of each of its windows, or below the window itself. What blocks find is merged by rank.

Two passes: positives are searched among the rows of the anchor's label, with one window open to both sides; then negatives in the windows
that the positives' scores open. Anchors go in chunks, and each (block, chunk) is a task of its own, so neither side of a
task grows with the table, whatever share of rows one label has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates of a block, anchors of a chunk, rows read from each list before the first test of the threshold.
BLOCK_ROWS, CHUNK_ROWS, FIRST_DEPTH = 16_384, 1024, 16
#: Scores must fit a long: rows whose integer vector is as long as this or longer cannot be scored.
LONGEST = 2.0**31


def _whole(scale: float):
    """Rows (id, label, vector) with the vector as little-endian 32-bit integers; rows that hold null, non-finite or too large components go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            offsets = np.asarray(vectors.offsets)
            first = int(offsets[0]) if len(offsets) else 0
            flat = vectors.values.slice(first, int(offsets[-1]) - first if len(offsets) else 0).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(all="ignore"):
                c = np.floor(scale * flat)
                square = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(c), np.minimum(c * c, LONGEST**2), 0))])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(c) | (np.abs(c) >= LONGEST))])
            a, z = offsets[:-1] - first, offsets[1:] - first
            fine = (bad[z] == bad[a]) & (square[z] - square[a] < LONGEST**2)
            data = np.where(np.isfinite(c), np.clip(c, -LONGEST, LONGEST - 1), 0).astype("<i4")
            packed = [data[x:y].tobytes() for x, y in zip(a[fine], z[fine], strict=True)]
            keep = pa.array(fine)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("label").filter(keep), pa.array(packed, pa.binary()), pa.array((z - a)[fine].astype(np.int32))], ["id", "label", "c", "dim"])

    return run


class Lists:
    """A block of candidates with its per-dimension sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[by_id], labels[by_id], rows[by_id]  # ascending ids: equal scores keep that order
        self.down = np.argsort(-self.rows, axis=0, kind="stable").T.astype(np.int32)  # for each dimension the positions, largest value first
        self.looked = 0

    def search(self, own: int, label: int, anchor: np.ndarray, same: bool, windows: list[tuple[float, float]], k: int) -> list[tuple[int, int, int]]:
        """(window, id, score) of the first ``k`` rows of each window (lowest, highest score), among rows of the anchor's label or of others."""
        n, dim = self.rows.shape
        fits = (self.labels == label) & (self.ids != own) if same else self.labels != label
        fresh = np.ones(n, bool)
        met, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor >= 0)
        at, to = 0, min(n, FIRST_DEPTH) if dim else n
        while at < n:
            seen = np.zeros(n, bool) if dim else np.ones(n, bool)
            seen[self.down[down, at:to]] = True
            seen[self.down[up, n - to : n - at]] = True
            new = np.flatnonzero(seen & fresh)
            fresh[new] = False
            some = new[fits[new]]
            self.looked += len(new)
            met, scores = np.concatenate([met, some]), np.concatenate([scores, self.rows[some] @ anchor])
            if not fresh.any():
                break
            last = np.empty(dim, np.int64)
            last[down], last[up] = self.down[down, to - 1], self.down[up, n - to]
            threshold = self._threshold(self.rows[last, np.arange(dim)], anchor)
            if all(threshold < lo or (threshold < hi and threshold < self._kth(scores, lo, hi, k)) for lo, hi in windows):
                break
            at, to = to, min(n, 2 * to)
        found = []
        order = np.lexsort((met, -scores))
        met, scores = met[order], scores[order]
        for w, (lo, hi) in enumerate(windows):
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))[:k]
            found += [(w, int(self.ids[m]), int(s)) for m, s in zip(met[inside], scores[inside], strict=True)]
        return found

    @staticmethod
    def _threshold(values: np.ndarray, anchor: np.ndarray) -> float:
        """Their inner product; where it may not fit a long, a little more than it."""
        if anchor.dtype == np.float64:
            return float(values @ anchor)
        product = values.astype(np.float64) * anchor
        return float(product.sum() + 1e-9 * np.abs(product).sum() + 1)

    @staticmethod
    def _kth(scores: np.ndarray, lo: float, hi: float, k: int) -> float:
        inside = scores[(scores >= lo) & (scores <= hi)]
        return float("-inf") if len(inside) < k else int(np.partition(inside, len(inside) - k)[len(inside) - k])


def _rows(table: pa.Table) -> np.ndarray:
    dim = table.column("dim")[0].as_py()
    return np.frombuffer(b"".join(table.column("c").to_pylist()), "<i4").reshape(len(table), dim)


def _exact(*blocks: np.ndarray) -> type:
    """Doubles where scores and thresholds stay exact in them, else longs."""
    norms = [float(np.sqrt((b.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for b in blocks]
    return np.float64 if norms[0] * norms[1] * blocks[0].shape[1] ** 0.5 < 2.0**52 else np.int64


def _mine(same: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of candidates and a chunk of anchors: rows (anchor_id, key, of, found_id, score), ``of`` being the positive's score that opened the window."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(candidates) and len(anchors):
            x, y = _rows(candidates), _rows(anchors)
            kind = _exact(x, y)
            block = Lists(candidates.column("id").to_numpy(), candidates.column("label").to_numpy(), x.astype(kind))
            told = (anchors.column(n).to_pylist() for n in ("id", "key", "label", "opened"))
            for own, key, label, opened, c in zip(*told, y.astype(kind), strict=True):
                windows = [(o["lo"], o["hi"]) for o in opened] if opened else [(float("-inf"), float("inf"))]
                for w, i, score in block.search(own, label, c, same, windows, k):
                    out.append((own, key, opened[w]["of"] if opened else None, i, score))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["anchor_id", "key", "of", "found_id", "score"])

    return run


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is an integer inner product with the anchor, higher ones first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of the same label; for each one come the first ``negatives`` rows of other labels
    with lowest * positive_score <= 100 * negative_score <= highest * positive_score. A positive that finds none, or scores below 0, has no rows.

    Rows with a null id, label or vector, or a null or non-finite component take no part, nor do rows whose integer vector is 2**31 long
    or longer (its scores fit no long). Zero vectors take part, and empty ones among themselves; vectors of different length never meet. Rows equal in id, label
    and vector count once; of different rows that share an id each one counts, but none is a positive of its own id. Other columns are ignored; an empty table gives an empty result.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    whole = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = whole.where("id is not null and label is not null and v is not null and forall(v, x -> x is not null)")
    packed = whole.select("id", "label", "v").mapInArrow(_whole(scale), "id long, label long, c binary, dim int").distinct()
    rows = written(packed, "vectors")
    chosen = whole.where("anchor").select("id").distinct()
    own = written(rows.join(chosen.hint("shuffle_hash"), "id", "left_semi").withColumn("key", F.xxhash64("label", "c")), "anchors")  # key tells rows of one id apart

    chunks = lambda n: F.ceil(n / F.lit(CHUNK_ROWS)).cast("int")
    part = lambda c, salt: F.pmod(F.xxhash64("id", "c", F.lit(salt)), c).cast("int")
    found_schema = "anchor_id long, key long, of long, found_id long, score long"

    # Positives: blocks and chunks within a label, as many as it needs.
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    sizes = written(sizes.join(own.groupBy("label", "dim").agg(chunks(F.count("*")).alias("chunks")), ["label", "dim"]), "sizes")
    by = ["label", "dim", "block", "chunk"]
    left = rows.join(sizes.hint("shuffle_hash"), ["label", "dim"]).withColumn("block", part(F.col("blocks"), 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = own.join(sizes.hint("shuffle_hash"), ["label", "dim"]).withColumn("chunk", part(F.col("chunks"), 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none = F.lit(None).cast("array<struct<of:long,lo:long,hi:long>>").alias("opened")
    near = left.select(*by, "id", "c").groupBy(*by).cogroup(right.select(*by, "id", "key", "c", none).groupBy(*by)).applyInArrow(_mine(True, positives), found_schema)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "found_id")
    first = written(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    # Negatives: the windows that positives open, each score's once; all blocks.
    share = lambda percent, more: F.expr(f"(score div 100) * {percent} + ((score % 100) * {percent} + {more}) div 100")
    opened = F.array_distinct(F.collect_list(F.struct(F.col("score").alias("of"), share(lowest, 99).alias("lo"), share(highest, 0).alias("hi"))))
    windows = first.where("score >= 0").groupBy(F.col("anchor_id").alias("id"), "key").agg(opened.alias("opened"))
    seekers = written(own.join(windows.hint("shuffle_hash"), ["id", "key"]), "seekers")
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    sizes = written(sizes.join(seekers.groupBy("dim").agg(chunks(F.count("*")).alias("chunks")), "dim"), "sizes")
    by = ["dim", "block", "chunk"]
    # One row for each length of vector: k lengths take k * k / 2 components at least, so 100 TB hold 5 million of them at most.
    left = rows.join(F.broadcast(sizes), "dim").withColumn("block", part(F.col("blocks"), 3)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = seekers.join(F.broadcast(sizes), "dim").withColumn("chunk", part(F.col("chunks"), 4)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    far = left.select(*by, "id", "label", "c").groupBy(*by).cogroup(right.select(*by, "id", "key", "label", "c", "opened").groupBy(*by)).applyInArrow(_mine(False, negatives), found_schema)
    order = Window.partitionBy("anchor_id", "key", "of").orderBy(F.col("score").desc(), "found_id")
    far = written(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives")
    pairs = first.select("anchor_id", "key", F.col("found_id").alias("positive_id"), F.col("score").alias("of"))
    out = pairs.join(far.hint("shuffle_hash"), ["anchor_id", "key", "of"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("of").alias("positive_score"), F.col("score").alias("negative_score"))
