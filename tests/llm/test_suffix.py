"""The index of suffix arrays: levels, order, batches one after another, and both ways of the second look, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from parcelkit.llm import suffix
from tests.llm import brute

rng = random.Random(9)
words = lambda n: " ".join("".join(rng.choice("abcdeéž中") for _ in range(rng.randrange(1, 9))) for _ in range(n))
LINE, PASSAGE = words(9), words(80)
TEXTS = [words(60) for _ in range(12)] + [f"{words(40)} {LINE} {words(40)}" for _ in range(14)] + [f"{words(rng.randrange(50))}{PASSAGE}{words(rng.randrange(50))}" for _ in range(12)]
TEXTS += [TEXTS[3], TEXTS[3], TEXTS[20], PASSAGE * 3, "ab" * 400, "", None, "x" * 199, "y" * 200, "y" * 200]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("batches, many", [(1, 4096), (2, 4096), (5, 4096), (2, 1)])
def test_against_brute_force(docs, monkeypatch, batches, many):
    """Any number of batches gives the same, and so does the shuffle of windows that crowded anchors take."""
    monkeypatch.setattr(suffix, "MANY", many)
    got = {r.doc_id: r for r in suffix.remove_repeats(docs, batches=batches).collect()}
    want = brute.repeats(TEXTS)
    assert [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in (got[i] for i in range(len(TEXTS)))] == want
    assert sum(w[1] > 0 for w in want) > 15


def test_levels(spark, docs):
    """Sizes are those of a binary counter; every level is one sorted table of all its batches' suffixes."""
    index = suffix.SuffixIndex()
    sizes, per_batch = [], []
    for b in range(5):
        index.add(docs.where(F.col("doc_id") % 5 == b).select(F.col("doc_id").alias("k"), "text"))
        sizes.append([n for n, _ in index.levels])
        per_batch.append(index.levels[-1][1].count() if index.levels[-1][0] == 1 else None)
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    rows = index.levels[0][1].withColumn("file", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).collect()
    files = {}
    for r in sorted(rows, key=lambda r: r.n):
        files.setdefault(r.file, []).append((r.head, r.anchor, r.span, r.k, r.at))
    assert all(x == sorted(x) for x in files.values())
    ends = sorted((x[0], x[-1]) for x in files.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    total = index.levels[0][1].count() + index.levels[1][1].count()
    assert total == docs.select(F.col("doc_id").alias("k"), "text").mapInArrow(suffix._suffixes(200), "head long, anchor long, span long, k long, size long, at long, lo short, hi short").count()
    index.forget()


def test_one_word_over_and_over(spark):
    """A text that says one word again and again gives two suffixes of a kind and one run, not one for each word; what goes is the same."""
    texts = [f"{words(30)} {'Hehees ' * n}{words(30)}" for n in (400, 500, 600)] + [f"{words(30)} {'Hehees ' * 29}", f"{words(30)} {('a' * 700 + 'bc' * 300) * 2} {words(9)}", words(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("k"), "text")
    given = rows.mapInArrow(suffix._suffixes(200), "head long, anchor long, span long, k long, size long, at long, lo short, hi short")
    assert given.groupBy("k", *suffix.KIND).count().agg(F.max("count")).first()[0] == 2
    index = suffix.SuffixIndex()
    runs, _ = index.add(rows)
    assert 0 < runs.count() < 100  # 1,500 and more where each word is a suffix
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in (got[i] for i in range(len(texts)))] == brute.repeats(texts)
