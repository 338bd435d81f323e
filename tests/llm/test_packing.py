"""The packing plan on full histograms of lengths, against the least possible number of sequences."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelkit.llm import packing, queries, tokens

ROOM = 2048
DRAWN = np.clip(np.random.default_rng(0).lognormal(6.2, 0.9, 100_000), 1, ROOM).astype(int)
HISTOGRAMS = {
    "every length alike": {s: 40 for s in range(1, ROOM + 1)},
    "from 600 ids on": {s: 10 for s in range(600, ROOM + 1)},
    "drawn": dict(zip(*(x.tolist() for x in np.unique(DRAWN, return_counts=True)), strict=True)),
}


@pytest.mark.parametrize("name", list(HISTOGRAMS))
def test_full_histogram(name):
    lengths = HISTOGRAMS[name]
    assert sum(s > ROOM // 2 for s in lengths) > 700
    got, n = dict.fromkeys(lengths, 0), 0
    configs, report = packing.plan(lengths, ROOM)
    for times, config in configs:
        assert times > 0 and sum(s * c for s, c in config.items()) <= ROOM
        n += times
        for s, c in config.items():
            got[s] += times * c
    assert got == lengths
    least = max(-(-sum(s * c for s, c in lengths.items()) // ROOM), sum(c for s, c in lengths.items() if s > ROOM // 2))
    assert least <= n == report["sequences"] <= 1.001 * least and report["bound"] == least


def test_prices():
    """Against the plain dynamic program, one piece at a time; the choices say what they are worth."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        room = int(rng.integers(20, 60))
        sizes = np.flatnonzero(rng.random(room - 1) < 0.5) + 1
        value = rng.random(len(sizes))
        want = np.zeros(room + 1)
        for c in range(1, room + 1):
            want[c] = max([want[c - 1], *(want[c - s] + v for s, v in zip(sizes, value, strict=True) if s <= c)])
        best, last = packing.prices(value, sizes, room)
        assert best == pytest.approx(want)
        at, worth = room, 0.0
        while at > 0 and last[at] != -1:
            worth, at = (worth + value[last[at]], at - sizes[last[at]]) if last[at] >= 0 else (worth, at - 1)
        assert worth == pytest.approx(best[room])


def test_program_bound():
    """Where large pieces waste room, the program's own bound tells: 300 of 1100 take one of 700 each, 300 more go in pairs."""
    configs, report = packing.plan({1100: 300, 700: 600}, ROOM)
    assert report["sequences"] == sum(t for t, _ in configs) == 450 and 430 <= report["bound"] <= 450
    assert packing.plan({700: 999}, ROOM)[1]["sequences"] == 500
    assert packing.plan({}, ROOM) == ([], {"sequences": 0, "bound": 0, "solved": 0.0})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_documents(spark, sf):
    """The registered query's number of sequences against the least possible, the share that the program places, and its time on the driver."""
    rows = tokens.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), queries.tokenizer())
    per = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    began = time.process_time()
    _, report = packing.plan(per, ROOM)
    took = time.process_time() - began
    print(sf, report, f"{took:.1f} s")
    assert report["sequences"] <= -(-sum(s * n for s, n in per.items()) // ROOM) + 1 + report["bound"] // 1000
    assert report["solved"] >= 0.5 and took < 10


def test_packed_rows(spark):
    rows = spark.range(2 * ROOM).select("id", (F.col("id") % ROOM + 1).alias("length"))
    got = packing.pack(rows, ROOM).groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 2 * ROOM and all(r.ids == r.end <= ROOM for r in got)
    assert len(got) == ROOM + 1
