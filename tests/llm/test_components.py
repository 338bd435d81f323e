"""Components of chains, stars and random graphs against union-find, and the rounds that they take."""

import random

import pytest

from parcelkit.llm import components
from tests.llm import brute

rng = random.Random(4)
SHUFFLED = rng.sample(range(600), 600)
GRAPHS = {
    "empty": [],
    "rising chain": [(i, i + 1) for i in range(10_000)],
    "chain in random order": list(zip(SHUFFLED, SHUFFLED[1:], strict=False)),
    "star": [(500, i) for i in range(1000) if i != 500],
    "star of chains": [(0 if k == 0 else 100 * c + k, 100 * c + k + 1) for c in range(20) for k in range(60)],
    "random": [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1500)],
    "repeated, loops and nulls": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (2, 6)],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_components(spark, monkeypatch, name):
    tags = []
    keep = components.written
    monkeypatch.setattr(components, "written", lambda df, tag: (tags.append(tag), keep(df, tag))[1])
    links, sets = GRAPHS[name], brute.Union()
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    for a, b in real:
        sets.join(a, b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {(r.id, r.component_id) for r in got} == {(x, sets.root(x)) for x in {y for link in real for y in link}}
    assert len(got) == len({r.id for r in got}) and tags.count("hooks") <= 12


def test_labels_inside_a_task():
    """A path of 300 rows in random order, and a row by itself."""
    import numpy as np

    from parcelkit.llm.embed_dedup import _smallest_label

    way, linked = rng.sample(range(300), 300), np.zeros((301, 301), bool)
    for a, b in zip(way, way[1:], strict=False):
        linked[a, b] = linked[b, a] = True
    ids = np.array(rng.sample(range(1000), 301))
    assert _smallest_label(linked, ids).tolist() == [ids[:300].min()] * 300 + [ids[300]]


def test_more_links_join_groups(spark):
    """Links in two parts give what all of them give at once; nulls and an empty second part change nothing."""
    draw = random.Random(5)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    plain = lambda df: {r.id: r.component_id for r in df.collect()}
    first = components.connected_components(table(links[:130]), "a", "b")
    whole = plain(components.connected_components(table(links), "a", "b"))
    got = plain(components.with_links(first, table([*links[130:], (None, 3), (4, None)]), "a", "b"))
    assert {k: v for k, v in got.items() if k in whole} == whole
    assert all(v == k for k, v in got.items() if k not in whole)
    assert plain(components.with_links(first, table([]), "a", "b")) == plain(first)
