"""The pipeline's filters where ids repeat or are null."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelkit.llm.common import written
from parcelkit.llm.queries import tokenizer

from . import brute

KIND = "doc_id long, text string, source string"
TEXT = " ".join(f"word{k}" for k in range(40))


@pytest.mark.parametrize("shared", [None, 7])
def test_classify_by_row(spark, monkeypatch, shared):
    """A refused row takes no other row of its id with it."""
    docs = spark.createDataFrame([(shared, "junk", "a"), (shared, "clean one", "a"), (shared, "clean two", "b"), (1, "junk", "a"), (2, "clean", "a")], KIND)

    def told(rows, labels, id_col="doc_id", row_col=None):
        return rows.select(*filter(None, [id_col, row_col]), (F.col("text") != "junk").alias("kept"))

    monkeypatch.setattr(corpus_pipeline.quality, "importance_sample", told)
    got = corpus_pipeline.classify(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == ["clean", "clean one", "clean two"]


@pytest.mark.parametrize("shared", [None, 9_000_000])
def test_classify_refuses_rows(spark, shared):
    """The classifier itself: a third of the rows under one id, the same texts refused as with ids of their own."""
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("mine", F.col("doc_id"))
    hot = docs.withColumn("doc_id", F.when((F.col("doc_id") % 3 != 0) | F.col("doc_id").isin([r[0] for r in spark.read.parquet(f"{at}/labels.parquet").select("doc_id").collect()]), F.col("doc_id")).otherwise(F.lit(shared)))
    want = {r.mine for r in corpus_pipeline.classify(spark, docs, at).collect()}
    got = {r.mine for r in corpus_pipeline.classify(spark, hot, at).collect()}
    assert len(want ^ got) <= 0.02 * len(want)


def test_near_copies_by_row(spark):
    """One of each group stays, with and without ids; a text of its own stays whatever else has its id."""
    other = " ".join(f"other{k}" for k in range(40))
    alone = " ".join(f"alone{k}" for k in range(40))
    rows = [
        (1, TEXT, "a"), (5, TEXT, "b"), (5, alone, "a"),  # 5 has a copy of 1 and a text of its own
        (None, other, "a"), (None, other + " end", "a"), (None, other, "a"), (None, "a text of its own without id", "b"),
        (8, None, "a"), (8, None, "a"), (9, "", "a"),
    ]
    docs = spark.createDataFrame(rows, KIND)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert [r for r in got if r[1] == TEXT] == [(1, TEXT, "a")]
    assert len([r for r in got if r[1] and r[1].startswith(other)]) == 1
    assert {(5, alone, "a"), (None, rows[6][1], "b"), (8, None, "a"), (9, "", "a")} < set(got) and len(got) == 6


def check_pieces(got, rows):
    """The pieces of ``rows`` (id, text), each as often as it stands there, without gaps in their sequences."""
    from tokenizers import Tokenizer

    library, want, by = Tokenizer.from_file(tokenizer()), Counter(), defaultdict(list)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    return len(by)


def test_stages_after_the_classifier(spark):
    """All of sf0.001 with planted passages, rows without id, text or source, equal rows and a clashing column, each stage against its plain version; then run() itself."""
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("_row", F.lit("mine"))
    long = " ".join(f"pasáž{k}" for k in range(60))
    own, other = (" ".join(f"{c}{k}{c}" for k in range(80)) for c in "ab")
    planted = [(9_000_001, f"{own} {long} end"), (9_000_002, f"{other} {long} é"), (9_000_003, long), (None, f"{TEXT} a text of its own"), (9_000_004, None), (9_000_005, "")]
    more = [[i, t, None if k % 2 else "planted", 0] for k, (i, t) in enumerate(planted)]
    extra = spark.createDataFrame(more, "doc_id long, text string, source string, n_chars int")
    docs = written(docs.unionByName(extra.withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType)).withColumn("_row", F.lit("mine")), allowMissingColumns=True), "docs")
    _, near, repeats, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]

    first = written(near(spark, docs, at), "first")
    component = brute.near_copies([(-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()], width=5)
    best = defaultdict(list)
    for i, (_, c) in component.items():
        best[c].append((i == -1, i))
    assert sorted(-1 if i is None else i for i, *_ in rows(first)) == sorted(min(x)[1] for x in best.values())
    assert first.columns == docs.columns and {r._row for r in first.collect()} == {"mine"}

    second = written(repeats(spark, first, at), "second")
    before = rows(first)
    want = Counter((i, t, s) for (i, old, s), t in zip(before, brute.without_repeats([t for _, t, _ in before]), strict=True) if t == old or t.strip(" "))
    after = rows(second)
    assert Counter(after) == want and second.columns == docs.columns
    assert (9_000_001, f"{own}end", "planted") in after and 9_000_003 not in {i for i, *_ in after}
    assert all(r.n_chars == len(r.text) for r in second.collect() if r.text)

    third = written(mix(spark, second, at), "third")
    taken = Counter()
    for row, n in zip(after, brute.mixed(after), strict=True):
        taken[row] += n
    assert Counter(rows(third)) == +taken and third.columns == docs.columns
    check_pieces(pack(spark, third, at).collect(), [(i, t) for i, t, _ in rows(third)])


def test_run(spark):
    """run() gives what its stages give one after the other, whole and packed as closely as can be."""
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, at), "stage")
    got = corpus_pipeline.run(spark, at).collect()
    n = check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1 + sum(r.length for r in got) // 2048 * 1.01
