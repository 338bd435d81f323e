"""Operators on small literal inputs: what the test tables do not show."""

import json
import re

import pytest
from pyspark.sql import functions as F

from parcelkit.operators import intake, legends, paths
from parcelkit.streaming import reviews

SQUARE = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
INNER = [(25.0, 25.0), (75.0, 25.0), (75.0, 75.0), (25.0, 75.0)]
CORE = [(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0)]


def shapes(spark, items):
    """Polygons of one drawing, as lists of the number of points of each ring."""
    row = spark.createDataFrame([(0, 1, items)], f"collection_id int, drawing_index int, items {paths.ITEMS}")
    return [[len(r) for r in p] for p in paths.polygons(row).head().polygons]


@pytest.mark.parametrize(
    "items, want",
    [
        ([("l", [(10.0, 10.0), (90.0, 10.0)]), ("l", [(90.0, 10.0), (90.0, 80.0)]), ("l", [(90.0, 80.0), (10.0, 10.0)])], [[4]]),
        ([("l", [(10.0, 10.0), (90.0, 10.0)]), ("l", [(90.0, 80.0), (90.04, 10.0)]), ("l", [(90.0, 80.0), (10.0, 10.03)])], [[4]]),
        ([("l", [(0.0, 0.0), (90.0, 0.0)]), ("l", [(300.0, 0.0), (300.0, 9.0)])], []),
        ([("re", SQUARE), ("re", INNER)], [[5, 5]]),
        ([("re", SQUARE), ("re", INNER), ("qu", CORE)], [[5, 5], [5]]),
        ([("re", SQUARE), ("re", [(500.0, 0.0), (501.0, 0.0), (501.0, 1.0), (500.0, 1.0)])], [[5], [5]]),
        ([("zz", SQUARE), None, ("l", [])], []),
        ([], []),
        (None, []),
    ],
)
def test_polygons(spark, items, want):
    assert shapes(spark, items) == want


def test_holes_larger_than_their_ring_go(spark):
    left, right = [(1.0, 1.0), (99.0, 1.0), (99.0, 98.0), (1.0, 98.0)], [(1.0, 2.0), (98.0, 2.0), (98.0, 99.0), (1.0, 99.0)]
    right[0] = (0.5, 2.0)
    assert shapes(spark, [("re", SQUARE), ("re", left), ("re", right)]) == [[5]]


def test_curve_closes_with_a_line(spark):
    rings = shapes(spark, [("c", [(0.0, 0.0), (0.0, 50.0), (100.0, 50.0), (100.0, 0.0)]), ("l", [(100.0, 0.0), (0.0, 0.0)])])
    assert len(rings) == 1 and rings[0][0] > 4


def test_numbers_run_through_chunks(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("collection_id"), (F.col("id") * 7).alias("k"))
    got = paths.numbered(rows, "n", "k", chunk=32).orderBy("collection_id", "k").collect()
    assert [r.n for r in got] == [*range(1, 26), *range(1, 26)]


def test_replay(spark):
    ring = [*SQUARE, SQUARE[0]]
    rows = spark.createDataFrame([(1, [ring]), (2, [ring]), (3, None)], f"id int, rings array<{paths.RING}>")
    log = spark.createDataFrame([(1, 2, "insert", 50.0, -5.0), (1, 1, "delete_last", 0.0, 0.0), (1, 3, "unknown", 0.0, 0.0), (3, 1, "insert_default", 0.0, 0.0)], "id int, seq int, op string, x double, y double")
    got = {r.id: r.rings for r in paths.replay_vertex_edits(rows, log, ["id"]).collect()}
    assert [tuple(p) for p in got[1][0]] == [(0.0, 0.0), (50.0, -5.0), (100.0, 0.0), (100.0, 100.0), (0.0, 0.0)]
    assert [tuple(p) for p in got[2][0]] == ring and got[3] is None


def test_left_legend(spark):
    codes = ["B", "BI", "BV", "BH", "BU", "BX.c", "R", "RI", "S", "SO", "SV"]
    rows = [(1, k, c, 100.0, 1200.0 + 40 * k, 130.0, 1215.0 + 40 * k) for k, c in enumerate(codes)] + [(1, 20, "Bydlení individuální", 330.0, 1240.0, 470.0, 1255.0), (1, 21, "  ", 0.0, 0.0, 1.0, 1.0), (1, 22, None, 0.0, 0.0, 1.0, 1.0)]
    spans = spark.createDataFrame(rows, "collection_id int, span_index int, raw_text string, x0 double, y0 double, x1 double, y1 double")
    best = legends.select_legend(legends.legend_candidates(spans, (5051.0, 3019.0))).head()
    assert (best.strategy, best.codes, best.score, best.band) == ("target_left_legend_code_cluster_v1", 11, 0.96, "high")
    assert (best.bx0, best.by0, best.bx1, best.by1) == (15.0, 1145.0, 560.0, 1690.0)


def test_label_quality(spark):
    rows = spark.createDataFrame([("  Plochy   bydlení ", None), ("%%<>ab", "BI"), (None, "XX"), ("", None)], "t string, c string")
    got = [tuple(r.q) for r in rows.select(legends.label_quality(F.col("t"), F.col("c")).alias("q")).collect()]
    unread = ("label unreadable - review", "manual_required", 0.0)
    assert got == [("Plochy bydlení", "ok", 0.82), ("BYDLENÍ INDIVIDUÁLNÍ", "agent_proposed", 0.55), unread, unread]


def test_feature_collections(spark, tmp_path):
    feature = {"type": "Feature", "id": "a", "properties": {"LAYER": "RZVP", "FID": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "Feature", "features": [feature]}))
    (tmp_path / "c.geojson").write_text("no json")
    got = intake.read_feature_collections(spark, str(tmp_path)).collect()
    assert [(r.feature_id, r.properties["LAYER"], r.geometry_type, r.coordinates) for r in got] == [("a", "RZVP", "Point", "[1,2]")] * 2


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"TYPES": {"STAV": ["stav", "stabil.*"]}, "CLASSES": {"RZVP.BI": "Bydlení"}}, indent=1))
    assert {tuple(r) for r in intake.load_vocabulary(spark, str(tmp_path)).collect()} == {("TYPES", "STAV", "stav"), ("TYPES", "STAV", "stabil.*"), ("CLASSES", "RZVP.BI", "Bydlení")}


EVENT = "event_id long, ts timestamp, collection_id int, target_id long, action string, area_after double"


def test_streams_go_on_and_drop_repeats(spark, tmp_path):
    """Two files in two runs: the second run reads only the new file, repeats of the first run's events do not come again."""
    from datetime import datetime

    at = lambda day: datetime(2024, 1, day)
    batches = [[(1, at(1), 0, 7, "edit", 1.0), (2, at(2), 0, 7, "approve", 2.0), (2, at(2), 0, 7, "approve", 2.0)], [(2, at(2), 0, 7, "approve", 2.0), (3, at(3), 0, 8, "edit", 3.0), (4, at(1), 0, 7, "label", 4.0)]]
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        for start, folder in ((reviews.review_log, log), (reviews.latest_state, state)):
            start(spark.readStream.schema(EVENT).parquet(source), folder).awaitTermination()
    assert sorted(r.event_id for r in reviews.read_rows(spark, log).collect()) == [1, 2, 3, 4]
    got = {r.target_id: (r.events, r.event_id, r.action) for r in reviews.read_state(spark, state).collect()}
    assert got == {7: (5, 2, "approve"), 8: (1, 3, "edit")}


def test_latest_state_is_written_whole(spark, tmp_path):
    """With a whole table after every second batch: what is read, a mark for each, and nothing lost where such a table broke off or a batch ran again."""
    from datetime import datetime

    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for day in range(1, 6):
        spark.createDataFrame([(day, datetime(2024, 1, day), 0, 7, f"a{day}", 1.0), (10 + day, datetime(2024, 1, day), 0, 20 + day, "edit", 2.0)], EVENT).coalesce(1).write.mode("append").parquet(source)
        if day == 4:  # half a table of the next whole state, without its mark
            spark.range(3).write.parquet(f"{state}/whole/3")
        reviews.latest_state(spark.readStream.schema(EVENT).parquet(source), state, every=2).awaitTermination()
        got = {r.target_id: (r.events, r.action) for r in reviews.read_state(spark, state).collect()}
        assert got == {7: (day, f"a{day}")} | {20 + d: (1, "edit") for d in range(1, day + 1)}
    assert sorted(r.batch for r in spark.read.parquet(f"{state}/marks").collect()) == [1, 3]
    now = reviews.read_state(spark, state)
    plan = now._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: [^\n]*batch#\d+ > 3\)", plan) and any("/whole/3/" in f for f in now.inputFiles())


def test_visual_artifacts(spark):
    """All five classes of holes, voids by vertices and size, a feature without rings, masks by role, and a collection without primary features."""
    from parcelkit.operators import annotation

    def ring(x, y, w, h):
        return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h)), (float(x), float(y))]

    outer = ring(0, 0, 100, 100)
    tri = [(10.0, 10.0), (30.0, 10.0), (10.0, 30.0), (10.0, 10.0)]
    star = [(0.0, 0.0), (60.0, 0.0), (6.0, 6.0), (0.0, 60.0), (0.0, 0.0)]  # fills little of its box
    step = [(10.0, 10.0), (30.0, 10.0), (30.0, 22.0), (14.0, 22.0), (14.0, 19.0), (10.0, 19.0), (10.0, 10.0)]  # 95 % of its box, over 1.8 % of the outer ring
    notch = [(10.0, 10.0), (30.0, 10.0), (30.0, 14.0), (25.0, 14.0), (25.0, 20.0), (10.0, 20.0), (10.0, 10.0)]  # 85 %
    rows = [
        (1, 1, [outer, ring(5, 5, 10, 10)], 9900.0, 0.8, True, False, False, ["artifact_requires_review", "needle_spike_candidate"], "#ffffff"),
        (1, 2, [outer, tri, star], 9000.0, 0.6, False, True, True, ["artifact_requires_review"], "#d9483f"),
        (1, 3, [outer, step, ring(40, 40, 30, 30)], 9000.0, 0.1, None, None, None, [], None),
        (1, 4, None, None, None, None, None, None, None, None), (1, 5, [outer, notch], 9830.0, 0.2, False, False, False, [], None),
    ]
    kind = "collection_id int, fid int, rings array<array<struct<x:double,y:double>>>, area double, spike double, needle boolean, sliver boolean, corridor boolean, flags array<string>, style_hex string"
    primary = spark.createDataFrame(rows, kind).withColumn("export_eligible", F.lit(False))
    raw = spark.createDataFrame([(1, "#ffffff", 2.0, "background_mask_fragment"), (1, "#ffffff", None, None), (1, "#000000", 5.0, "unknown_fragment"), (2, None, None, None)], "collection_id int, style_hex string, area double, role string")
    got = {r.collection_id: r.asDict() for r in annotation.visual_artifacts(raw, primary, ["collection_id", "fid"]).collect()}
    one, two = got[1], got[2]
    assert (one["white_fragments"], float(one["white_area"]), one["background_masks"], one["trusted_white"]) == (2, 2.0, 1, 1)
    assert (one["max_spike"], one["spikes"], one["spike_reviews"], one["needles"], one["slivers"], one["corridors"]) == (0.8, 2, 1, 1, 1, 1)
    assert (one["holes"], one["label_masks"], one["hatch_grids"], one["white_backgrounds"], one["real_voids"], one["unknown_holes"]) == (6, 2, 1, 1, 1, 1)
    assert (one["removed_holes"], one["cleaned_candidates"], one["hole_reviews"], one["triangular_voids"], one["void_reviews"]) == (4, 4, 1, 1, 1)
    assert one["rectangular"] == 3 and one["rect_reviews"] == 3 and one["void_matches_plan"] == "requires_plan_visual_review"
    assert two["holes"] == two["spikes"] == two["export_blocked"] == 0 and two["void_source"] is None and two["void_matches_plan"] == "not_applicable"
