import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelkit.llm import negatives

from . import brute

SCHEMA = "vec_id long, label int, embedding array<double>, score string, of int"


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def points(seed, n, dim=6, labels=3):
    """Clustered vectors on a coarse grid, so that scores tie; a third of all rows has one label."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, dim))
    x = np.round(centres[r.integers(8, size=n)] + 0.3 * r.standard_normal((n, dim)), 1)
    return [(int(i), int(0 if i % 3 == 0 else i % labels), v.tolist()) for i, v in zip(r.permutation(n), x, strict=True)]


@pytest.mark.parametrize("block, chunk", [(16_384, 1024), (64, 3)])
def test_equals_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    rows = points(5, 700)
    want = brute.hard_negatives(rows, lambda i: i % 50 == 0)
    assert len(want) > 50 and mined(spark, rows) == want


def test_edges(spark):
    rows = points(6, 120)
    rows += [(200, None, [1.0] * 6), (250, 1, None), (300, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, 1, [float("nan")] + [0.0] * 5), (400, 1, [float("inf")] + [0.0] * 5), (None, 1, [1.0] * 6)]
    rows += [(450, 2, [0.0] * 6), (500, 2, [1.0, 2.0]), (501, 2, [1.0, 2.0]), (502, 0, [0.5, 1.0]), (550, 4, []), (551, 4, []), (552, 5, [])]
    rows += [rows[3], rows[3], (50, 2, [0.5] * 6), (50, 1, [0.7] * 6), (600, 1, [-1.0] * 6)]
    want = brute.hard_negatives(rows, lambda i: i % 50 == 0)
    assert mined(spark, rows) == want
    assert {450, 500, 550} <= {w[0] for w in want}
    assert mined(spark, []) == [] and mined(spark, rows[120:126]) == []


def test_large_components_stay_exact(spark):
    rows = [(50, 0, [2.0**22, 1.0]), (1, 0, [2.0**22, 0.5]), (2, 1, [3.0 * 2**20, 2.0]), (3, 1, [3.0 * 2**20, 1.0]), (4, 1, [1e30, 0.0])]
    assert mined(spark, rows) == brute.hard_negatives(rows[:4], lambda i: i % 50 == 0)


def test_stops_before_it_has_looked_at_every_row():
    r = np.random.default_rng(3)
    axis = r.integers(8, size=4096)
    x = np.floor(256 * (np.eye(8)[axis] * r.uniform(0.5, 1, 4096)[:, None] + 0.01 * r.standard_normal((4096, 8))))
    block = negatives.Lists(np.arange(4096), axis % 2, x)
    anchor = np.floor(256 * np.eye(8)[0])
    best = block.search(-1, 0, anchor, True, [(float("-inf"), float("inf"))], 5)
    order = np.lexsort((np.arange(4096), -(x @ anchor)))
    assert [i for _, i, _ in best] == [int(i) for i in order if axis[i] % 2 == 0][:5]
    assert block.looked < 1024
