"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parcelkit.llm import minhash, mixing, packing, quality, sharding, suffix, tokens
from parcelkit.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k * 7919 % 10007}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
DOCS = [
    (1, None, "a"), (2, "", "a"), (3, "word", None), (4, "Word", "b"), (5, "a b c d e f g h i j k l", "b"), (6, "A b C d e f g h i j k l", "b"),
    (7, LONG, "c"), (8, LONG, "c"), (9, "é中\U0001f600 žluť x", "\U0001f600"), (10, " \t\n ", ""), (11, f"one {PASSAGE} two", "c"), (12, f"three {PASSAGE} four", None),
]
#: Names that the operators use inside or add.
CLASHING = "id n size part shard slot copies target source_size kept spans length piece start bands sketch ticket before fits component_id n_bytes sequence_id offset weight score good rate word hub band key".split()
VECTORS = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (8, [0.0, 1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 1.0])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Tables with the edge cases, under the names that the queries read."""
    at = str(tmp_path_factory.mktemp("edges"))
    docs.select("*", F.lit("cs").alias("lang"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(5, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "http://e.org", None), (2, None, "x"), (None, "", "x")], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (3, 0, "assistant", "</turn> \\<b>#")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "embeddings", "labels", "conversations", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_empty_tables(spark, empty, name):
    got = q.QUERIES[name](spark, empty)
    assert got.columns == q.QUERIES[name](spark, empty).columns
    assert got.count() == (1 if name.startswith("op6") else 0)


def test_op1(spark, folder):
    got = {r.vec_id: (r.n_links, r.component_id) for r in q.op1_embedding_near_dedup(spark, folder).collect()}
    assert got == brute.vector_links(VECTORS)


def test_op2(spark, folder):
    n, least = brute.check_packing(q.op2_best_fit_packing(spark, folder).collect(), [(i, t) for i, t, _ in DOCS], q.tokenizer())
    assert n <= least + 1


def test_op3_without_target_text_keeps_all(spark, folder):
    got = q.op3_quality_classifier(spark, folder).collect()
    assert len(got) == len(DOCS) and {r.doc_id for r in got if r.kept} >= {1, 2, 10}


@pytest.mark.parametrize("width", [2, 5])
def test_op4(docs, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == brute.near_copies([(i, t) for i, t, _ in DOCS], width)


def test_op5(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(q.tokenizer())
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in q.op5_token_counts(spark, folder).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in DOCS}


def test_op7(spark, folder):
    got = {r[0]: tuple(r[1:]) for r in q.op7_suffix_array_dedup(spark, folder).collect()}
    texts = [t for _, t, _ in DOCS]
    assert got == dict(zip([i for i, *_ in DOCS], brute.repeats(texts), strict=True))
    assert got[7][1] == len(LONG) and got[11][1] > 200


def test_op8(spark, folder):
    got = {r.doc_id: r for r in q.op8_source_mixing(spark, folder).collect()}
    assert set(got) == {i for i, *_ in DOCS} and all(r.taken <= 3 * r.size for r in got.values())
    assert got[1].size == got[10].size == 0 and got[3].source_size == got[12].source_size == 63


def test_op9(spark, folder):
    got = defaultdict(list)
    for r in q.op9_nearest_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == {k: v[:5] for k, v in brute.nearest(VECTORS, lambda i: i % 50 == 0).items()}


def test_op10(spark, folder):
    got = q.op10_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == [i for i, *_ in DOCS]
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_clashing_names(spark, clashing):
    """Extra columns stay or are replaced by the operator's own; all rows come back."""
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").withColumn("id", F.lit("x")).withColumn("good", F.lit("x"))
    n = len(DOCS)
    assert minhash.near_duplicates(clashing).count() == n
    assert suffix.remove_repeats(clashing).count() == n
    assert mixing.mix(clashing).count() == n
    assert quality.importance_sample(clashing, labels).count() == n
    assert tokens.count_tokens(clashing, q.tokenizer()).count() == n
    assert packing.pack(tokens.pieces(clashing, q.tokenizer()), key=["doc_id", "piece"]).select("doc_id").distinct().count() == n
    ring = sharding.bounded_ring(clashing.withColumn("size", F.lit(7)), "doc_id", "size", 4)
    assert ring.count() == n and Counter(ring.columns).most_common(1)[0][1] == 1


def test_repeated_rows(docs):
    """Rows with one id and text are one document to the near-copy search and two to the repeats."""
    twice = docs.unionByName(docs.where("doc_id in (1, 5, 11)"))
    assert minhash.near_duplicates(twice).where("doc_id = 5").select("component_id").distinct().count() == 1
    assert suffix.remove_repeats(twice).count() == len(DOCS) + 3
    assert mixing.mix(twice).count() == len(DOCS) + 3
    assert sharding.bounded_ring(twice.withColumn("size", F.lit(5)), "doc_id", "size", 3).groupBy("shard").agg(F.count_distinct("slot").alias("a"), F.count("*").alias("b")).where("a != b").isEmpty()


def test_ids_beside_a_null_one_come_back_as_they_are(spark, tmp_path):
    """All operators that carry ids, with ids that a double cannot hold."""
    ids = [None, 2**53 + 1, 2**53 + 3, -(2**62) - 1]
    at = str(tmp_path)
    docs = spark.createDataFrame([(i, f"some words of text {k}", "s", "cs", 9) for k, i in enumerate(ids)], "doc_id long, text string, source string, lang string, n_chars long").coalesce(1)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(2**53 + 1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, [1.0, k / 10], 0) for k, i in enumerate(ids)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, f"http://e.org/{k}", "x") for k, i in enumerate(ids)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    for name in ("op1_embedding_near_dedup", "op2_best_fit_packing", "op3_quality_classifier", "op4_minhash_near_dedup", "op5_token_counts", "op7_suffix_array_dedup", "op8_source_mixing", "op10_sharding", "op13_warc"):
        got = q.QUERIES[name](spark, at)
        assert Counter(r[0] for r in got.select(got.columns[0] if name != "op13_warc" else "page_id").collect()) == Counter(ids), name
    packed = packing.pack(docs.select("doc_id", F.lit(5).alias("length"), F.col("doc_id").cast("double").alias("id")))
    assert Counter(r.doc_id for r in packed.collect()) == Counter(ids)
    near = q.QUERIES["op9_nearest_neighbours"](spark, at)
    assert near.count() == 0  # none of these ids is divisible by 50
