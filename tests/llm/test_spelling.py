import itertools
import random

from parcelkit.llm import spelling

from . import brute


def found(spark, docs, least=3):
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, word string")
    out = spelling.spelling_variants(df, least=least)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()), key=str)


def test_all_words_of_two_letters_count_each_near_word_once(spark):
    r = random.Random(4)
    words = ["".join(x) for n in (5, 6, 7) for x in itertools.product("ab", repeat=n) if r.random() < 0.6]
    docs = [(k, " ".join(w for w in words for _ in range(r.choice([0, 3, 3, 9, 40, 200])))) for k in range(3)]
    want = brute.spelling(docs)
    assert found(spark, docs) == want
    assert any(x[1] and x[2] != x[1] for x in want)  # a chain of forms


def test_edges(spark):
    docs = [(None, "Straße STRASSE strasse. straße"), (7, None), (8, ""), (9, "Étude étude-ÉTUDE 12 a×b÷cÿd a×b÷cÿd řeka prefixřeka"), (9, "house House hose houses houše" * 40), (9, "house House hose houses houše" * 40)]
    docs += [(-1, "q" * 300 + " " + "q" * 299 + " " + "q" * 301), (2**62, ("abcde " * 400) + ("abcdf " * 200) + "abcdg " * 200)]
    for least in (1, 2, 3):
        n = brute.spelling(docs, least=least)
        assert found(spark, docs, least) == n
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_documents_of_the_test_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute.spelling(rows)


def test_a_group_over_several_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = [(1, " ".join(f"{a}bcde " * (3 + k) + f"{a}bxde " * 3 for k, a in enumerate("abcdefghijklmnopqrst")))]
        assert found(spark, docs) == brute.spelling(docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
