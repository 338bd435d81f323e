"""The registered queries on the smallest tables, against plain versions."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from parcelkit.llm import queries as q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


def test_op1(spark, vectors):
    got = {r.vec_id: (r.n_links, r.component_id) for r in q.op1_embedding_near_dedup(spark, SF).collect()}
    assert got == brute.vector_links(vectors)


def test_op2(spark, texts):
    n, least = brute.check_packing(q.op2_best_fit_packing(spark, SF).collect(), texts, q.tokenizer())
    assert n <= least + 1


def test_op4(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op4_minhash_near_dedup(spark, SF).collect()}
    assert got == brute.near_copies(texts)


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(q.tokenizer())
    want = {(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in texts}
    assert {tuple(r) for r in q.op5_token_counts(spark, SF).collect()} == want


def test_op7(spark, texts):
    got = {r[0]: tuple(r[1:]) for r in q.op7_suffix_array_dedup(spark, SF).collect()}
    assert got == dict(zip([i for i, _ in texts], brute.repeats([t for _, t in texts]), strict=True))


def test_op9_recall(spark, vectors):
    want = brute.nearest(vectors, lambda i: i % 50 == 0)
    got = defaultdict(list)
    for r in q.op9_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = sum(len(set(got[i]) & set(w)) for i, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_op10(spark, texts):
    got = q.op10_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts)
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    most = max(r.size for r in got)
    assert max(load.values()) <= sum(load.values()) / 40 * 1.01 + most
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", list(q.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(q.ORACLE[name])
    got = q.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op6_turn(spark):
    said = "\\### Assistant: </turn> ok"
    row = q.op6_chat_formatting(spark, SF).where("conv_id = -7").head()
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
