"""Queries on paths, polygons and holes, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import documents as d
from ..operators import evidence as e
from ..operators import paths as p
from .catalogue import AREA, FRAGMENTS, SHAPE, _profile, query
from .views import view

KEY = ["collection_id", "drawing_index"]
#: Fragments as paths: rectangles are one item, triangles three lines; every fifth rectangle has an inner one of half its sides.
PATHS = SHAPE + ", p AS (SELECT *, holed AND shape = 'rect' AS inner_rect, coalesce(fill_hex = '#ffffff', false) AND abs(x0) <= 1.5 AND abs(y0) <= 1.5 AND abs(x0 + w - 1200) <= 1.5 AND abs(y0 + h - 1700) <= 1.5 AS page FROM f)"


def _drawings(spark, sf_dir):
    """Fragments as items of paths; a triangle's second line is drawn backwards."""
    f = view(spark, sf_dir, "v_fragments")
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    item = lambda op, *points: F.struct(F.lit(op).alias("op"), F.array(*points).alias("points"))
    box = lambda x, y, w, h: item("re", g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y + h))
    a, b, c = g.point(x, y), g.point(x + w, y), g.point(x + w, y + h)
    lines = F.array(item("l", a, b), item("l", c, b), item("l", c, a))
    return f.withColumn("items", F.when(F.col("shape") == "tri", lines).when(F.col("drawing_index") % 5 == 0, F.array(box(x, y, w, h), box(x + w / 4, y + h / 4, w / 2, h / 2))).otherwise(F.array(box(x, y, w, h))))


def _polygons(spark, sf_dir, least=p.LEAST):
    return p.polygons(_drawings(spark, sf_dir), least)


def _parts(spark, sf_dir):
    """Rectangles; those with an odd drawing_index have a second part of a tenth of their sides."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    ring = lambda x, y, w, h: F.array(F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y + h), g.point(x, y)))
    both = F.array(ring(x, y, w, h), ring(x + w + 1, y, w / 10, h / 10))
    return view(spark, sf_dir, "v_fragments").withColumn("parts", F.when(F.col("drawing_index") % 2 == 1, both).otherwise(F.slice(both, 1, 1)))


@query("d1_path_items", PATHS + " SELECT collection_id, CASE WHEN shape = 'tri' THEN 'l' ELSE 're' END AS op, CAST(sum(CASE WHEN shape = 'tri' THEN 3 WHEN inner_rect THEN 2 ELSE 1 END) AS BIGINT) AS items, count(*) AS drawings FROM p GROUP BY ALL", FRAGMENTS)
def _d1(spark, sf_dir):
    per = p.path_items(_drawings(spark, sf_dir)).groupBy(*KEY, "op").agg(F.count("*").alias("n"))
    return per.groupBy("collection_id", "op").agg(F.sum("n").alias("items"), F.count("*").alias("drawings"))


@query("d2_flatten_curves", """, k AS (SELECT collection_id, CAST(greatest(4, least(16, floor((abs(y0 + h - y0) + abs(x0 + w - x0) + abs(y0 - (y0 + h))) / greatest(abs(x0 + w - x0), 1e-6) * 4))) AS INTEGER) AS segments FROM v_fragments)
SELECT collection_id, segments, count(*) AS curves, CAST(sum(segments) AS BIGINT) AS points FROM k GROUP BY collection_id, segments""", FRAGMENTS)  # fmt: skip
def _d2(spark, sf_dir):
    """Arches over the fragments: up one side, across, down the other."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    arch = F.array(g.point(x, y), g.point(x, y + h), g.point(x + w, y + h), g.point(x + w, y))
    rows = view(spark, sf_dir, "v_fragments").select("collection_id", p.curve_segments(arch).alias("segments"), F.size(p.flatten_curve(arch)).alias("points"))
    return rows.groupBy("collection_id", "segments").agg(F.count("*").alias("curves"), F.sum("points").alias("points"))


@query("d3_rings", PATHS + " SELECT collection_id, shape, CAST(sum(CASE WHEN inner_rect THEN 2 ELSE 1 END) AS BIGINT) AS rings, sum(CAST(outer_area AS DECIMAL(18,3))) + coalesce(sum(CASE WHEN inner_rect THEN CAST(w * h / 4 AS DECIMAL(18,3)) END), 0) AS area FROM p GROUP BY ALL", FRAGMENTS)
def _d3(spark, sf_dir):
    rows = _drawings(spark, sf_dir).select("collection_id", "shape", F.explode_outer(p.assemble_rings(F.col("items"))).alias("ring")).where("ring is not null")
    return rows.groupBy("collection_id", "shape").agg(F.count("*").alias("rings"), F.sum(g.ring_area_abs(F.col("ring")).cast(AREA)).alias("area"))


@query("d4_polygons", PATHS + " SELECT collection_id, shape, count(*) AS polygons, count(*) FILTER (inner_rect) AS holes, sum(CAST(CASE WHEN inner_rect THEN outer_area - w * h / 4 ELSE outer_area END AS DECIMAL(18,3))) AS area FROM p GROUP BY ALL", FRAGMENTS)
def _d4(spark, sf_dir):
    rows = _polygons(spark, sf_dir).select("collection_id", "shape", F.explode_outer("polygons").alias("polygon")).where("polygon is not null")
    return rows.groupBy("collection_id", "shape").agg(F.count("*").alias("polygons"), F.sum(F.size("polygon") - 1).alias("holes"), F.sum(g.polygon_area(F.col("polygon")).cast(AREA)).alias("area"))


@query("d5_features", PATHS + " SELECT collection_id, drawing_index, row_number() OVER (PARTITION BY collection_id ORDER BY drawing_index) AS fid, shape = 'rect' AS only_rects FROM p WHERE fill_hex IS NOT NULL AND NOT page", FRAGMENTS)
def _d5(spark, sf_dir):
    return p.emit_features(_polygons(spark, sf_dir), d.PAGE, [*KEY, "only_rects"]).select(*KEY, "fid", "only_rects")


@query("d5_extraction_counters", PATHS + """ SELECT collection_id, count(*) FILTER (fill_hex IS NOT NULL) AS filled, count(*) FILTER (fill_hex IS NOT NULL AND outer_area <= 0.01) AS without_polygon, count(*) FILTER (page) AS backgrounds,
count(*) FILTER (fill_hex IS NOT NULL AND shape = 'tri' AND NOT page) AS path_polygons, count(*) FILTER (fill_hex IS NOT NULL AND shape = 'rect' AND NOT page) AS rect_polygons, 0::BIGINT AS curves, 0::BIGINT AS quads FROM p GROUP BY collection_id""", FRAGMENTS)  # fmt: skip
def _d5c(spark, sf_dir):
    return p.extraction_counters(_polygons(spark, sf_dir), d.PAGE)


@query("d6_geometry_errors", PATHS + " SELECT collection_id, drawing_index, 'filled_drawing_without_polygon' AS error, CAST(CASE WHEN shape = 'tri' THEN 3 WHEN inner_rect THEN 2 ELSE 1 END AS INTEGER) AS items FROM p WHERE fill_hex IS NOT NULL AND outer_area <= 1.005", FRAGMENTS)
def _d6(spark, sf_dir):
    """Rings of at most 1.005 square points go here; at the usual 0.01 none does."""
    return p.geometry_errors(_polygons(spark, sf_dir, 1.005))


@query("d8_single_polygons", """, k AS (SELECT *, unnest(range(1 + drawing_index % 2)) AS part FROM v_fragments)
SELECT collection_id, drawing_index, CAST(part AS INTEGER) AS part_index, CAST(1 + drawing_index % 2 AS INTEGER) AS part_count, CAST(CASE WHEN part = 0 THEN w * h ELSE w * h / 100 END AS DECIMAL(18,3)) AS area FROM k""", FRAGMENTS)  # fmt: skip
def _d8(spark, sf_dir):
    return p.split_multipolygons(_parts(spark, sf_dir)).select(*KEY, "part_index", "part_count", g.polygon_area(F.col("polygon")).cast(AREA).alias("area"))


@query("b12_vertex_edits", SHAPE + """, k AS (SELECT *, drawing_index % 3 AS m, CASE WHEN shape = 'tri' THEN 4 ELSE 5 END AS n FROM f)
SELECT collection_id, drawing_index, CAST(CASE WHEN m = 0 THEN n + 1 WHEN m = 2 AND shape = 'rect' THEN 4 ELSE n END AS INTEGER) AS points, CAST(CASE WHEN m = 2 AND shape = 'rect' THEN outer_area / 2 ELSE outer_area END AS DECIMAL(18,3)) AS area FROM k""", FRAGMENTS)  # fmt: skip
def _b12(spark, sf_dir):
    """By drawing_index: insert; insert, then delete it; delete a corner."""
    rows = d.rings(view(spark, sf_dir, "v_fragments"))
    ops = F.when(F.col("drawing_index") % 3 == 0, F.array(F.lit("insert_default"))).when(F.col("drawing_index") % 3 == 1, F.array(F.lit("insert_default"), F.lit("delete_last"))).otherwise(F.array(F.lit("delete_last")))
    log = rows.select(*KEY, F.posexplode(ops).alias("seq", "op"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    outer = F.get("rings", F.lit(0))
    return p.replay_vertex_edits(rows, log, KEY).select(*KEY, F.size(outer).alias("points"), g.ring_area_abs(outer).cast(AREA).alias("area"))


@query("i2_void_metrics", SHAPE + """ SELECT collection_id, drawing_index, 0 AS triangular, CAST(CASE WHEN holed AND (w * h / 4 <= 35 OR least(w, h) / 2 <= 2.5) THEN 1 ELSE 0 END AS INTEGER) AS small, CAST(CASE WHEN holed THEN 1 ELSE 0 END AS INTEGER) AS voids,
round(CASE WHEN holed THEN w * h / 4 / greatest(outer_area, 1.0::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS void_ratio FROM f""", FRAGMENTS)  # fmt: skip
def _i2(spark, sf_dir):
    return p.void_metrics(d.rings(view(spark, sf_dir, "v_fragments"))).select(*KEY, "triangular", "small", "voids", F.round("void_ratio", 6).alias("void_ratio"))


@query("i4_clean_candidates", SHAPE + " SELECT collection_id, drawing_index, 1 AS removed, 1 AS rings_left, CAST(outer_area AS DECIMAL(18,3)) AS area FROM f WHERE holed AND (w * h / 4 <= 35 OR least(w, h) / 2 <= 2.5)", FRAGMENTS)
def _i4(spark, sf_dir):
    rows = d.rings(view(spark, sf_dir, "v_fragments"))
    out = p.clean_candidates(rows, e.hole_classes(rows), KEY)
    return out.select(*KEY, "removed", F.size("cleaned").alias("rings_left"), g.polygon_area(F.col("cleaned")).cast(AREA).alias("area"))


@query("i5_components", " SELECT collection_id, drawing_index, CAST(1 + drawing_index % 2 AS INTEGER) AS components, CAST(1 + drawing_index % 2 AS INTEGER) AS ring_count, CAST(drawing_index % 2 AS INTEGER) AS islands FROM v_fragments", FRAGMENTS)
def _i5(spark, sf_dir):
    return p.component_metrics(_parts(spark, sf_dir)).select(*KEY, "components", "ring_count", "islands")


@query("i6_hole_summary", SHAPE + """, k AS (SELECT collection_id, sum(CAST(CASE WHEN holed THEN outer_area - w * h / 4 ELSE outer_area END AS DECIMAL(18,3))) AS area, count(*) FILTER (holed) AS holes, sum(CASE WHEN holed THEN CAST(w * h / 4 AS DECIMAL(18,3)) END) AS rect_area FROM f GROUP BY collection_id)
SELECT collection_id, area, holes, holes AS rectangular, rect_area, round(rect_area::DOUBLE / (area + rect_area)::DOUBLE, 6) AS rect_ratio, CASE WHEN rect_area::DOUBLE / (area + rect_area)::DOUBLE >= 0.025 THEN holes ELSE 0 END AS to_review FROM k""", FRAGMENTS)  # fmt: skip
def _i6(spark, sf_dir):
    return p.hole_summary(_profile(spark, sf_dir), e.hole_classes(d.rings(view(spark, sf_dir, "v_fragments"))))
