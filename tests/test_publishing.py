"""Literal tests of remapping with overrides, edits, published rows and rules, and of whole styles."""

import datetime as dt
import json

import duckdb
import pytest

from parcelkit.operators import definitions, publishing
from parcelkit.plans import catalogue, definitions as plan_definitions, publishing as plan  # noqa: F401

SF = "/root/testdata/sf0.01"
SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
RINGS = "array<array<struct<x:double,y:double>>>"
OVERRIDE = "collection_id int, target_kind string, target_id long, ts timestamp, override_id long, override_layer string, override_class string, override_type string, override_group string, override_label string, note string"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_edits(spark):
    hole = [SQUARE[0], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]
    rows = [
        (1, "Polygon", SQUARE, hole, None), (2, "Polygon", None, SQUARE, "drawn anew"), (3, "Polygon", SQUARE, [SQUARE[0][:3] + SQUARE[0][:1]], " "), (4, "MultiPolygon", SQUARE, SQUARE, None),
        (5, "Polygon", SQUARE, [SQUARE[0][:4]], None), (6, "Polygon", SQUARE, None, None), (7, None, None, [], None),
    ]
    got = {r.id: r for r in publishing.validate_polygon_edits(spark.createDataFrame(rows, f"id int, geometry_type string, rings_before {RINGS}, rings_after {RINGS}, note string")).collect()}
    assert [(got[k].status, got[k].change) for k in (1, 2, 3, 4)] == [("saved", 6.25), ("saved", 100.0), ("needs_note", 50.0), ("invalid", 0.0)]
    assert [got[k].errors for k in (4, 5, 6, 7)] == [["not_a_polygon"], ["ring_not_closed", "no_positive_area"], ["ring_not_closed", "no_positive_area"], ["not_a_polygon", "ring_not_closed", "no_positive_area"]]
    assert (got[6].change, got[7].change) == (100.0, 0.0)


def test_overrides_and_remap(spark):
    over = spark.createDataFrame(
        [
            (1, "feature", 10, at(1), 1, "RZVP", "BI", "STAV", None, "first", None), (1, "feature", 10, at(2), 2, "CUST", "X", "NAVRH", None, None, "why"), (1, "feature", 11, at(1), 3, "ZMEN", "XZ", "NAVRH", None, "z", None),
            (1, "profile", 12, at(1), 4, "RZVP", "BI", "STAV", None, "p", None), (2, "feature", 10, at(9), 5, "RZVP", "SV", "STAV", None, "elsewhere", None), (1, "feature", 13, at(3), 6, "CUST", "X", "REZERVA", "g", "mine", "why"),
        ],
        OVERRIDE,
    )
    assert {r.override_id: r.violations for r in publishing.check_overrides(over).collect()} == {1: [], 2: ["custom_label_required"], 3: ["custom_note_required"], 4: [], 5: [], 6: []}
    features = spark.createDataFrame(
        [(1, 10, "ZMEN", "K", None, None), (1, 11, "RZVP", "MO", "stav", "7"), (1, 12, "CUST", "Q", "STAV", "5"), (1, 13, None, None, None, None), (1, 14, "CUST", "X", "STAV", None), (1, 15, "RZVP", "nothing", "zastavitelné", None)],
        "collection_id int, fid long, layer string, class string, type_text string, ref string",
    )
    got = {r.fid: r for r in publishing.remap_features(features, *plan._vocabulary(spark), publishing.latest_overrides(over)).collect()}
    assert len(got) == 6 and (got[10].rule, got[10].proposed_class_type, got[10].display_label, got[10].score, got[10].review) == ("manual_override", "BI.1", "first", 1.0, False)
    assert (got[11].rule, got[11].group_label, got[11].display_label, got[11].proposed_class_type) == ("class_map", "Q - Městských Sídel", "MO - městské obytné (7)", "MO.1")
    assert (got[12].rule, got[12].display_label, got[12].score, got[12].review) == ("custom_ref", "CUST.Q - 5", 0.78, False)
    assert (got[13].proposed_layer_class, got[13].group_label, got[13].display_label) == ("CUST.X", "g", "mine")
    assert (got[14].rule, got[14].review) == ("class_map", True) and (got[15].proposed_layer_class, got[15].proposed_class_type, got[15].group_label) == ("RZVP.UNMAPPED", "UNMAPPED.0", None)
    alone = {r.fid: r for r in publishing.remap_features(features, *plan._vocabulary(spark)).collect()}
    assert (alone[10].rule, alone[10].proposed_type, alone[13].proposed_layer_class, alone[13].score) == ("class_map", "NAVRH", "UNCLASSIFIED.UNMAPPED", 0.0)


def test_both_joins_of_names_agree(spark, monkeypatch):
    features = plan._features(spark, SF)
    want = publishing.remap_features(features, *plan._vocabulary(spark)).exceptAll
    monkeypatch.setattr(publishing, "SMALL", 3)
    assert want(publishing.remap_features(features, *plan._vocabulary(spark))).isEmpty()


def test_published_rows(spark):
    """The last review decides, the last saved edit replaces the geometry, a label stands beside text_id."""
    staging = spark.createDataFrame([(1, n, 100 + n, "u", "RZVP", "BI", "REZERVA", "t", SQUARE, 1, "a", 0.5) for n in range(4)], f"collection_id int, fid long, stg_polygon_id long, up_id string, layer string, class string, type string, text_id string, rings {RINGS}, source_page int, source_algorithm_id string, confidence double")
    reviews = spark.createDataFrame([(100, 1, at(1), "approved", "x"), (101, 2, at(1), "approved", "x"), (101, 3, at(2), "rejected", "x"), (102, 4, at(1), "rejected", "x"), (102, 5, at(1), "approved", "y")], "stg_polygon_id long, review_id long, ts timestamp, decision string, reviewed_by string")
    wide = [[(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    edits = spark.createDataFrame([(1, 100, at(1), "Polygon", SQUARE, wide, None), (2, 100, at(2), "Polygon", SQUARE, [], None)], f"manual_edit_id long, stg_polygon_id long, ts timestamp, geometry_type string, rings_before {RINGS}, rings_after {RINGS}, note string")
    over = publishing.latest_overrides(spark.createDataFrame([(1, "feature", 2, at(1), 1, "RZVP", "BI", "STAV", None, "mine", None)], OVERRIDE))
    core = publishing.core_rows(staging, reviews, edits, over)
    got = {r.fid: r for r in core.collect()}
    assert set(got) == {0, 2} and (got[0].manual_edit_id, got[0].rings[0][1].x, got[0].label_override) == (1, 5.0, None)
    assert (got[2].label_override, got[2].text_id, got[2].reviewed_by, got[2].class_type, got[2].source_stg_polygon_id) == ("mine", "t", "y", "BI.3", 102)
    told = {r.fid: json.loads(r.feature) for r in publishing.core_geojson(core).collect()}
    assert told[0]["geometry"] == {"type": "Polygon", "coordinates": [[[x, y] for x, y in wide[0]]]} and len(told[0]["properties"]) == 13 and told[0]["properties"]["label_override"] is None


def test_every_rule_is_broken_somewhere():
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    counts = con.sql(f"SELECT rule, sum(n) AS n, min(n) AS least FROM ({catalogue.ORACLE['m5_rule_counts']}) GROUP BY rule").fetchall()
    assert len(counts) == 13 and all(n > 0 for _, n, _ in counts) and any(least == 0 for _, _, least in counts)


def test_violations_as_rows(spark):
    rows = spark.createDataFrame([(1, "EPSG:5514", "ZMEN", "STAV", True, False, None), (2, "x", "RZVP", None, None, True, "r"), (3, None, "ZMEN", None, None, None, None)], "id int, coordinate_system string, layer string, type string, has_fill boolean, is_custom boolean, ref string")
    assert sorted((r.id, r.rule) for r in publishing.rule_violations(rows, "definitions").collect()) == [(1, "no_fake_crs"), (1, "zmen_has_no_fill"), (1, "zmen_is_navrh")]


def test_styles_of_first_drawing(spark):
    """Three features of a drawing and eight of a style are named; one drawing without features marks the style, the first one decides its status."""
    draw = lambda n, fill, ops: (1, n, fill, None, None, None, 1.0, None, None, ops)
    drawings = spark.createDataFrame([draw(1, "#1", ["l", "l"]), draw(2, "#1", ["l", "l"]), draw(3, "#1", ["l"]), draw(4, None, None), *[draw(n, "#2", []) for n in range(5, 20)]], "collection_id int, drawing_index long, fill_hex string, stroke_hex string, fill_opacity double, stroke_opacity double, stroke_width double, dashes string, layer string, ops array<string>")
    features = spark.createDataFrame([(1, 1, f"a{k}", 1.0, 1) for k in range(5)] + [(1, n, f"b{n:02}", 2.0, 0) for n in range(6, 20)] + [(1, None, "lost", 9.0, 9)], "collection_id int, drawing_index long, feature_id string, area double, holes int")
    got = {r.vector_def_id: r for r in definitions.style_definitions(drawings, features).collect()}
    one, other, bare, many = (got[f"vector-def-000{k}"] for k in (1, 2, 3, 4))
    assert (one.path_ops, one.sample_count, one.emitted_features, one.hole_count, float(one.area)) == ("l=2", 2, 5, 5, 5.0) and one.sample_feature_ids == ["a0", "a1", "a2"]
    assert one.rejected_reason and one.candidate_status == "candidate" and one.is_closed and other.candidate_status == "requires_review" and not other.is_closed
    assert bare.rejected_reason is None and bare.sample_feature_ids == [] and (many.sample_count, many.sample_feature_ids) == (15, [f"b{n:02}" for n in range(6, 14)])
    assert many.candidate_status == "requires_review" and definitions.style_definitions(drawings.limit(0), features).count() == 0


@pytest.mark.parametrize("name", ["h1_tessellation_scores"])
def test_both_outcomes(spark, name):
    assert {r.detected for r in catalogue.QUERIES[name](spark, SF).collect()} == {True, False}


def test_skips(spark):
    rows = spark.createDataFrame([(1, "map_body_region", None), (1, "map_body_region", "hatch_fragment"), (1, None, "area_fill_candidate"), (1, "legend_candidate_region", None)], "collection_id int, region string, role string")
    assert {(r.reason, r.n) for r in definitions.merge_skips(rows).collect()} == {("hatch_fragment", 1), ("non_map_region", 2)}
