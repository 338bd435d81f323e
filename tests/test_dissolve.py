"""Unions of polygons: shared edges, overlaps, holes, touching corners, islands, groups."""

import pytest

from parcelkit.operators import dissolve as ds

box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
CASES = {
    "two halves": ([[box(0, 0, 5, 10)], [box(5, 0, 10, 10)[::-1]]], [(100, 0)]),
    "overlap": ([[box(0, 0, 6, 10)], [box(4, 2, 10, 8)]], [(60 + 24, 0)]),
    "copies": ([[box(0, 0, 6, 10)], [box(0, 0, 6, 10)]], [(60, 0)]),
    "inside": ([[box(0, 0, 10, 10)], [box(2, 2, 4, 4)]], [(100, 0)]),
    "frame": ([[box(0, 0, 30, 10)], [box(0, 20, 30, 30)], [box(0, 10, 10, 20)], [box(20, 10, 30, 20)]], [(800, 1)]),
    "hole kept": ([[box(0, 0, 20, 20), box(5, 5, 15, 15)]], [(300, 1)]),
    "hole filled": ([[box(0, 0, 20, 20), box(5, 5, 15, 15)], [box(5, 5, 15, 15)]], [(400, 0)]),
    "island in a hole": ([[box(0, 0, 20, 20), box(2, 2, 18, 18)], [box(6, 6, 10, 10)]], [(144, 1), (16, 0)]),
    "corner": ([[box(0, 0, 5, 5)], [box(5, 5, 10, 10)]], [(25, 0), (25, 0)]),
    "long edge beside two": ([[box(0, 0, 10, 5)], [box(0, 5, 4, 9)], [box(4, 5, 10, 9)]], [(90, 0)]),
    "triangles": ([[[(0, 0), (10, 0), (10, 10), (0, 0)]], [[(0, 0), (10, 10), (0, 10), (0, 0)]]], [(100, 0)]),
    "too small": ([[box(0, 0, 3, 3)]], []),
}


@pytest.fixture(scope="module")
def found(spark):
    kind = f"name string, style string, polygon long, rings {ds.RINGS}"
    rows = [(name, style, k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for name, (polygons, _) in CASES.items() for style in (None, "#ff0000") for k, rings in enumerate(polygons)]
    out = {}
    for r in ds.dissolve(spark.createDataFrame(rows, kind), ["name", "style"], cell=7.0).orderBy("component").collect():
        out.setdefault((r.name, r.style), []).append(r)
    return out


@pytest.mark.parametrize("style", [None, "#ff0000"])
@pytest.mark.parametrize("name", list(CASES))
def test_union(found, name, style):
    rows = found.get((name, style), [])
    assert [(round(r.area, 6), r.holes) for r in rows] == [(float(a), h) for a, h in CASES[name][1]]
    assert [r.component for r in rows] == list(range(1, len(rows) + 1)) and all(ring[0] == ring[-1] and len(ring) >= 4 for r in rows for ring in r.rings)


def test_straight_corners_go(found):
    """Points between pieces of one line are no corners."""
    assert len(found["two halves", None][0].rings[0]) == 5 and len(found["triangles", None][0].rings[0]) == 5


RESIDUAL = {
    # name: (source, generated, missing area and polygons with holes, extra area and polygons with holes)
    "alike": ([[box(0, 0, 10, 10)]], [[box(0, 0, 5, 10)], [box(5, 0, 10, 10)]], (0, []), (0, [])),
    "shifted": ([[box(0, 0, 10, 10)]], [[box(2, 3, 12, 13)]], (100 - 56, [0]), (100 - 56, [0])),
    "nothing generated": ([[box(0, 0, 10, 10), box(4, 4, 6, 6)]], [], (96, [1]), (0, [])),
    "nothing to find": ([], [[box(0, 0, 10, 10)], [box(9, 0, 12, 10)]], (0, []), (120, [0])),
    "hole not kept": ([[box(0, 0, 20, 20), box(5, 5, 15, 15)]], [[box(0, 0, 20, 20)]], (0, []), (100, [0])),
    "hole made": ([[box(0, 0, 20, 20)]], [[box(0, 0, 20, 20), box(5, 5, 15, 15)]], (100, [0]), (0, [])),
    "inside": ([[box(0, 0, 20, 20)]], [[box(5, 5, 15, 15)]], (300, [1]), (0, [])),
    "in two": ([[box(0, 0, 20, 4)]], [[box(8, -5, 12, 9)]], (64, [0, 0]), (40, [0, 0])),
    "overlaps of the source": ([[box(0, 0, 6, 6)], [box(3, 0, 9, 6)], [box(0, 0, 6, 6)]], [[box(0, 3, 9, 6)]], (27, [0]), (0, [])),
    "triangles": ([[[(0, 0), (10, 0), (10, 10), (0, 0)]]], [[[(0, 0), (10, 0), (0, 10), (0, 0)]]], (25, [0]), (25, [0])),
}


def _layer(spark, which):
    rows = [(name, c, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for name, case in RESIDUAL.items() for c in (None, "BI") for rings in case[which]]
    return spark.createDataFrame(rows, f"name string, class string, rings {ds.RINGS}")


def test_residuals(spark):
    source, generated = _layer(spark, 0), _layer(spark, 1)
    areas = {(r.name, r["class"], r.kind): r.area for r in ds.residual_areas(source, generated, ["name", "class"]).collect()}
    found = {}
    for r in ds.residuals(source, generated, ["name", "class"]).collect():
        found.setdefault((r.name, r["class"], r.kind), []).append(r)
    for name, case in RESIDUAL.items():
        for c in (None, "BI"):
            for kind, (area, holes) in zip(("missing", "extra"), case[2:], strict=True):
                assert areas.get((name, c, kind), 0.0) == pytest.approx(area), (name, kind)
                rows = found.get((name, c, kind), [])
                assert sorted(r.holes for r in rows) == holes and sum(r.area for r in rows) == pytest.approx(area), (name, kind)


def test_rings_over_many_tiles(spark):
    """A long thin spiral of boxes: one ring far larger than a tile, cut at every level."""
    boxes = [[box(k, 0, k + 1, 1)] for k in range(3000)] + [[box(0, 2, 3000, 3)], [box(0, 1, 1, 2)]]
    rows = [("s", [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for rings in boxes]
    out = ds.dissolve(spark.createDataFrame(rows, f"name string, rings {ds.RINGS}"), ["name"], cell=0.5).collect()
    assert [(round(r.area, 6), r.holes, len(r.rings[0])) for r in out] == [(6001.0, 0, 9)]


def test_merged_features_and_gate(spark):
    """Two groups of a tessellation, one of one fragment, a document that is none."""
    boxes = [(1, k, "#a", "tessellated_area_fragment", box(k, 0, k + 1, 20)) for k in range(30)] + [(1, 100 + k, "#b", "area_fill_candidate", box(50 * k, 50, 50 * k + 5, 60)) for k in range(3)]
    boxes += [(1, 200, "#c", "area_fill_candidate", box(0, 90, 9, 99)), (1, 201, "#a", "text_mask_fragment", box(40, 0, 41, 20)), (2, 1, "#a", "area_fill_candidate", box(0, 0, 1, 1)), (2, 2, None, "hatch_fragment", box(0, 0, 1, 1)), (3, 1, "#a", "area_fill_candidate", box(0, 0, 5, 5)), (3, 2, "#a", "area_fill_candidate", box(9, 9, 14, 14))]
    rows = [(c, n, style, role, "map_body_region", float((r[2][0] - r[0][0]) * (r[2][1] - r[0][1])), [[{"x": float(x), "y": float(y)} for x, y in r]]) for c, n, style, role, r in boxes]
    df = spark.createDataFrame(rows, f"collection_id int, drawing_index long, fill_hex string, role string, region string, area double, rings {ds.RINGS}")
    metrics = spark.createDataFrame([(1, True), (2, False), (3, True)], "collection_id int, detected boolean")
    found = ds.merged_features(df, metrics, ["fill_hex"])
    got = sorted((r.collection_id, r.fid, r.mode, str(r.fill_hex), r.fragments, r.components, r.area, len(r.samples)) for r in found.collect())
    assert got == [
        (1, 1, "merged_polygons", "#a", 30, 1, 600.0, 12), *[(1, 2 + k, "merged_polygons", "#b", 3, 3, 50.0, 3) for k in range(3)], (2, 1, "raw_fragments", "#a", 1, 1, 1.0, 1), (2, 2, "raw_fragments", "None", 1, 1, 1.0, 1),
        *[(3, 1 + k, "merged_polygons", "#a", 2, 2, 25.0, 2) for k in range(2)],
    ]
    gate = {r.collection_id: (r.raw, r.primary_features, r.warn) for r in ds.quality_gate(df, metrics, found).collect()}
    assert gate == {1: (35, 4, False), 2: (2, 2, False), 3: (2, 2, True)}
