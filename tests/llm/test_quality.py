"""Importance resampling: models against plain dictionaries, the draw, held-out labels, ties."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelkit.llm import quality, tokens
from parcelkit.llm import queries as q

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def grams(text):
    """The n-grams of both families."""
    words = WORD.findall((text or "").encode())
    pairs = [(a, b) for a, b in zip(words, words[1:], strict=False)]
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    return [[*words, *words[:1], *pairs], [h for w in low for h in (w[:4], w[:5])]]


def test_weights_against_plain_models(spark):
    """Buckets rarely collide on a small table, so nearly all weights agree; order of the documents too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in quality.importance_sample(docs, labels).collect()}
    known = {r.id: r for r in labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3))).collect()}
    rows = [(r.doc_id, grams(r.text)) for r in docs.collect()]
    train = [g for i, g in rows if i in known and known[i].good == 1 and known[i].part != 0]
    for f, name in ((0, "quality_weight"), (1, "tone_weight")):
        raw, target = Counter(x for _, g in rows for x in g[f]), Counter(x for g in train for x in g[f])
        share = target.total() / raw.total()
        off = []
        for i, g in rows:
            total = 0.0
            for x in g[f]:
                t, e = target[x], raw[x] * share
                ratio = math.log((t + 0.5) / (e + 0.5))
                if f == 1:
                    ratio = min(0.0, ratio * max(0.0, 1 - 4 / max(1e-18, (t - e) ** 2 / (t + e + 1))))
                total += ratio
            off.append(abs(total / max(1, len(g[f])) ** (1.0, 0.5)[f] - got[i][name]))
        assert np.quantile(off, 0.9) < 0.05, name


def test_op3_keeps_clean_and_drops_bad(spark):
    at = "/root/testdata/sf0.1"
    got = q.op3_quality_classifier(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    low = [r.kept for r in got if r.quality == 0]
    toxic = [r.kept for r in got if r.toxic]
    assert sum(clean) >= 0.99 * len(clean) and sum(low) <= 0.05 * len(low) and sum(toxic) <= 0.2 * len(toxic)


def test_draw(spark):
    """``sample_size`` rows are drawn, those of higher weight far more often; texts without words weigh as the median target document."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    docs = docs.where("text is not null and trim(text) != ''").unionByName(docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit(" \n")))
    got = {r.doc_id: r for r in quality.importance_sample(docs, labels, sample_size=300).collect()}
    kept = [r for r in got.values() if r.kept]
    assert len(kept) == 300 and got[-1].weight == 1.0
    assert np.mean([r.weight for r in kept]) > np.mean([r.weight for r in got.values() if not r.kept])
    again = {r.doc_id: r for r in quality.importance_sample(docs, labels, sample_size=300).collect()}
    assert {i for i, r in got.items() if r.kept} == {i for i, r in again.items() if r.kept}


@pytest.mark.parametrize("sample_size", [None, 250])
def test_weight_score_and_draw_row_by_row(spark, sample_size):
    """From both weights of each row: levels against held-out target rows, noise by the hash's definition, the k best by sorting. Chance decides some rows, and not the threshold alone."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = quality.importance_sample(docs, labels, sample_size=sample_size).collect()
    held = {r.id for r in labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good")).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0).where("good = 1").collect()}
    wordless = {r.doc_id for r in docs.collect() if not WORD.search((r.text or "").encode())}
    levels = []
    for name in ("quality_weight", "tone_weight"):
        lo, mid = np.quantile([r[name] for r in got if r.doc_id in held], [quality.SPARE, 0.5])
        levels.append({r.doc_id: (r[name] - lo) / (mid - lo) for r in got})
    seed = xxhash.xxh64_intdigest(b"gumbel", 42)
    weight = {r.doc_id: 1.0 if r.doc_id in wordless else min(x[r.doc_id] for x in levels) for r in got}
    score = {}
    for i, w in weight.items():
        h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed)
        u = ((h - (h >> 63 << 64)) % 2**52 + 0.5) / 2**52
        score[i] = w / quality.TEMPERATURE - math.log(-math.log(u))
    k = sample_size or sum(w >= 0 for w in weight.values())
    best = set(sorted(score, key=score.get, reverse=True)[:k])
    for r in got:
        assert r.weight == pytest.approx(weight[r.doc_id], rel=1e-9, abs=1e-9) and r.score == pytest.approx(score[r.doc_id], rel=1e-9, abs=1e-6) and r.kept == (r.doc_id in best)
    crossed = best ^ set(sorted(weight, key=weight.get, reverse=True)[:k])
    assert crossed and (sample_size or max(abs(weight[i]) for i in crossed) < 1.5)


@pytest.mark.parametrize("values", [[], [3.0], [1.0] * 9000, [float(k * 7919 % 10_007) for k in range(10_000)], [0.0] * 5000 + [1e-300 * k for k in range(5000)] + [1e300]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (0, 1, 5, 4000, 20_000):
        assert quality.kth_largest(df, "v", k) == (sorted(values, reverse=True)[min(k, len(values)) - 1] if values and k else None)


def test_ties_at_the_last_place_stay(spark):
    """Rows alike in id and text score alike, so all of them stay or go."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = quality.importance_sample(docs.unionByName(docs), labels)
    assert got.count() == 2 * docs.count() and got.groupBy("doc_id").agg(F.count_distinct("kept").alias("n")).where("n > 1").isEmpty()


def test_buckets_grow():
    assert [quality.bucket_bits(n) for n in (0, 65_536, 65_537, 300_000, 10**7, 10**12)] == [18, 18, 19, 20, 22, 22]


def test_sums_do_not_depend_on_the_run():
    """A document's sum is the same behind any other documents of its run: single precision would lose it behind a million values."""
    values = np.full(1_000_003, 0.1, np.float32)
    alone, behind = quality._sums(values[-3:], np.array([0, 3])), quality._sums(values, np.array([0, 1_000_000, 1_000_003]))
    assert abs(alone[0] - behind[1]) < 1e-6


def test_encoder_is_given_up():
    """The classifier's tasks call this first: a worker that tokenized before does not keep the words it knew."""
    tokens.encoder(None, q.tokenizer())
    assert tokens.encoder.kept
    tokens.release()
    tokens.release()
    assert not hasattr(tokens.encoder, "kept")
    assert tokens.encoder(None, q.tokenizer())("a b")
