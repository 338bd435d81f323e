"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two families of n-grams, each with a model of the target text (labelled good) and one of the raw text (all documents).
Words with word pairs show junk: a document's quality weight is the mean of log(target / raw) over its n-grams. The first four and five
bytes of words show vocabulary that the target never uses: the tone weight is the sum over the root of their number, and two things keep
it from drowning in what says nothing: a bucket's log ratio shrinks by its own uncertainty (to 0 below SURE standard deviations), and
ratios above 1 count as 1, since common words of a long document would outweigh anything that tells against it. Models are
hashed; their buckets grow with the documents. Weights are set against those of held-out target documents (their lowest SPARE is 0,
their median 1); the smaller one counts. Gumbel top-k at TEMPERATURE draws as many documents as reach 0: a tenth of that span is the scale
of the noise, so documents near 0 change places by chance, while one at -1 stays out but with a chance of e^-10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash as th
from . import tokens
from .common import written

#: At most so many labelled rows, chosen by hash, say what target text is; they are broadcast (17 bytes each).
LABELLED_ROWS = 50_000
#: The count added to seen and to expected ones, standard deviations, the share of target documents that may fall below 0, temperature.
PRIOR, SURE, SPARE, TEMPERATURE = 0.5, 2.0, 0.003, 0.1
#: Bits of a family's bucket numbers: LEAST_BITS up to 65,536 documents, one more for four times as many, MOST_BITS (67 MB of counts on the driver) at most.
LEAST_BITS, MOST_BITS = 18, 22
_CHUNK, _SALTS = 4096, 16
#: Bytes of text that are worked on at once; the arrays of a run are many times as large.
_RUN = 500_000


def bucket_bits(rows: int) -> int:
    return min(MOST_BITS, LEAST_BITS + max(0, math.ceil(math.log2(max(1, rows) / 65_536) / 2)))


def log_ratios(target: np.ndarray, raw: np.ndarray, against: bool) -> np.ndarray:
    """log(target / raw) of each bucket from the counts of one family; ``against``: shrunk by its uncertainty, none above 0."""
    expected = raw * (target.sum() / max(1, raw.sum()))  # counts if target text were like raw text
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    if against:
        sigmas = np.abs(target - expected) / np.sqrt(target + expected + 1)
        ratio = np.minimum(0, ratio * np.maximum(0, 1 - (SURE / np.maximum(1e-9, sigmas)) ** 2))
    return ratio.astype(np.float32)


def _grams(data: np.ndarray, offsets: np.ndarray, bits: int = LEAST_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the buckets of all n-grams and the first one of each document."""
    ink = ~th._SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    first = np.searchsorted(start, offsets)
    word = th.Hashed(data)(start, end)
    pair = th.mix(np.concatenate([word[:1], word[:-1]]) * np.uint64(31) + word)
    pair[first[:-1][first[:-1] < len(pair)]] = word[first[:-1][first[:-1] < len(pair)]]  # the first word of a document stands alone
    low = th.Hashed(th._LOWER[data])
    heads = [low(start, np.minimum(end, start + n)) for n in (4, 5)]
    both = lambda a, b: (np.stack([a, b], 1).ravel() >> np.uint64(64 - bits)).astype(np.int64)
    return [(both(word, pair), 2 * first), (both(*heads), 2 * first)]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest value, by counting in ever finer bins: 1,024 counts or 4,096 values come to the driver at most."""
    rows = df.where(F.col(column).isNotNull())
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count("*")).head()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while hi > lo and n > 4096:
        width = (hi - lo) / 1024
        if lo + width <= lo:
            break
        at = F.least(F.lit(1023), F.floor((F.col(column) - F.lit(lo)) / F.lit(width)))
        counts = {int(r["at"]): (r["n"], r["lo"], r["hi"]) for r in rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if k <= n:
                break
            k -= n
        rows = rows.where(F.col(column).between(lo, hi))
    if lo == hi or n > 4096:
        return lo
    return sorted((r[0] for r in rows.select(column).collect()), reverse=True)[k - 1]


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good=None, row_col: str | None = None, sample_size: int | None = None) -> DataFrame:
    """Rows (id_col, quality_weight, tone_weight, weight, score, kept), one per row of ``docs``.

    ``good``: a condition on ``labels``, by default quality = 1 and toxic = 0; a null condition is false. Ids labelled more than once are good
    only if all their rows are. Null and empty texts, and texts without a word, have no n-grams: nothing tells against them, so they weigh
    as much as the median target document. Without labelled target documents nothing can be told apart: all weights are 0 and all
    rows kept. Repeated rows score alike; rows that tie at the last place all stay. Null ids are scored, never labelled.
    ``row_col``: a column that comes back with its row, so that rows of one id can be told apart. ``sample_size``: rows that are drawn, by
    default as many as weigh 0 or more. Raw counts cover all documents; the labelled sample is bounded by LABELLED_ROWS, a third of it calibrates.
    """
    spark = docs.sparkSession
    good = (F.col("quality") == 1) & (F.col("toxic") == 0) if good is None else good
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(LABELLED_ROWS).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).cast("int"))
    known = F.broadcast(written(known, "labelled"))
    row = ["row"] if row_col else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(row_col).alias(c) for c in row]).join(known, "id", "left")
    rows = rows.select("id", *row, "text", (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.col("part") == 0).alias("held"))

    bits = bucket_bits(docs.count())
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        table = np.zeros((2, 2, size), np.int64)
        for batch in batches:
            train = batch.column("good").to_numpy(zero_copy_only=False).astype(bool) & ~np.array([x is True for x in batch.column("held").to_pylist()], bool)
            for at, data, offsets in th.buffers(batch.column("text"), _RUN):
                for f, (bucket, first) in enumerate(_grams(data, offsets, bits)):
                    table[f, 0] += np.bincount(bucket, minlength=size)
                    table[f, 1] += np.bincount(bucket[np.repeat(train[at], np.diff(first))], minlength=size)
        if table.any():
            salt = TaskContext.get().partitionId() % _SALTS  # a task that runs again sends its counts where they went before
            parts = table.reshape(4, -1, _CHUNK)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(4 * parts.shape[1]), pa.int32()), "salt": pa.array([salt] * 4 * parts.shape[1], pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for y in parts for x in y], pa.binary())})

    def added(pdf: pd.DataFrame, kind: str) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8").astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "salt": [0], "counts": [total.astype(kind).tobytes()]})

    schema = "part int, salt int, counts binary"
    counts = rows.mapInArrow(count, schema).groupBy("part", "salt").applyInPandas(lambda pdf: added(pdf, "<i8"), schema).groupBy("part").applyInPandas(lambda pdf: added(pdf, "<f4"), schema)
    found = {r["part"]: np.frombuffer(r["counts"], "<f4") for r in counts.collect()}  # 4 numbers for each bucket
    table = np.array([found[k] for k in sorted(found)], np.float64).reshape(2, 2, size) if found else np.zeros((2, 2, size))
    trained = bool(table[:, 1].any())
    sent = spark.sparkContext.broadcast(np.stack([log_ratios(t[1], t[0], f == 1) for f, t in enumerate(table)]) if trained else np.zeros((2, size), np.float32))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            w: list[list[np.ndarray]] = [[], [], []]
            for _, data, offsets in th.buffers(batch.column("text"), _RUN):
                for f, (bucket, first) in enumerate(_grams(data, offsets, bits)):
                    w[f].append(_sums(sent.value[f][bucket], first) / np.maximum(1, np.diff(first)) ** (1.0, 0.5)[f])
                w[2].append(np.diff(first))
            w = [np.concatenate(x) if x else np.zeros(0) for x in w]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ["id", *row]), pa.array(w[0]), pa.array(w[1]), pa.array(w[2].astype(np.int64)), batch.column("good"), batch.column("held")], ["id", *row, "w0", "w1", "grams", "good", "held"])

    kinds = ", ".join(f"{c} {dict(docs.dtypes)[x]}" for c, x in zip(["id", *row], [id_col, row_col], strict=False))
    weighed = written(rows.mapInArrow(weigh, f"{kinds}, w0 double, w1 double, grams long, good boolean, held boolean"), "weights")
    marks = weighed.where("good and held").select(*[F.percentile(f"w{f}", F.lit(q)).alias(f"q{f}{n}") for f in (0, 1) for n, q in (("lo", SPARE), ("mid", 0.5))]).head()
    level = lambda f: (F.col(f"w{f}") - F.lit(marks[f"q{f}lo"])) / F.lit(max(marks[f"q{f}mid"] - marks[f"q{f}lo"], 1e-9))
    ready = trained and marks["q0lo"] is not None
    weight = F.least(level(0), level(1)) if ready else F.lit(0.0)
    u = (F.pmod(F.xxhash64(F.lit("gumbel"), F.col("id")), F.lit(2**52)) + 0.5) / float(2**52)
    scored = weighed.select("id", *row, F.col("w0").alias("quality_weight"), F.col("w1").alias("tone_weight"), F.when(F.col("grams") == 0, F.lit(1.0 if ready else 0.0)).otherwise(weight).alias("weight"), u.alias("u"))
    scored = scored.withColumn("score", F.col("weight") / TEMPERATURE - F.log(-F.log("u"))).drop("u")  # the k largest are a draw of k without replacement, by exp(weight / TEMPERATURE)
    k = scored.where("weight >= 0").count() if sample_size is None else sample_size
    last = kth_largest(scored, "score", k)
    kept = F.col("score") >= F.lit(-math.inf if last is None or not ready else last)
    return scored.select(F.col("id").alias(id_col), *[F.col(c).alias(row_col) for c in row], "quality_weight", "tone_weight", "weight", "score", kept.alias("kept"))
