"""Queries on annotation, artifact counts, extraction methods and legend styles, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as an
from ..operators import evidence as e
from ..operators import legends as lg
from ..sources.folders import written
from .catalogue import FRAGMENTS, LEGEND, SHAPE, _profile, _roles, query
from .records import SYMBOLS
from .views import ORDER, view

BOTH = ("v_fragments", "v_features")
#: Items and definitions of one code; fragments with their shape, hole and colour findings.
KNOWN = """, items AS (SELECT collection_id, 'BI' AS code, count(*) % 2 AS missing FROM v_features GROUP BY collection_id),
defs AS (SELECT collection_id, 'BI' AS code, min(style_hex) AS def_fill FROM v_features WHERE style_hex IS NOT NULL AND style_hex <> '#ffffff' GROUP BY collection_id)"""
FOUND = SHAPE + KNOWN + """, a AS (SELECT *, CASE WHEN holed THEN outer_area - w * h / 4 ELSE outer_area END AS area, CASE WHEN shape = 'tri' THEN w + h + sqrt(w * w + h * h) ELSE 2 * (w + h) END AS per, CASE WHEN shape = 'tri' THEN 3 ELSE 4 END AS v,
  CASE drawing_index % 4 WHEN 0 THEN 'BI' WHEN 1 THEN 'SX' END AS target_code, coalesce(fill_hex = '#ffffff', false) AS white, holed AND (w * h / 4 <= 35 OR least(w, h) / 2 <= 2.5) AS small FROM f),
b AS (SELECT *, greatest(w, h) / greatest(least(w, h), 1e-9) AS aspect, 4 * pi() * area / (per * per) AS compactness, v / sqrt(greatest(area, 1.0::DOUBLE)) AS complexity FROM a),
m AS (SELECT *, 0.35::DOUBLE * least(aspect / 30, 1) + 0.2::DOUBLE * (1 - least(compactness / 0.18::DOUBLE, 1)) + 0.15::DOUBLE * least(complexity / 18, 1) AS spike, compactness <= 0.035 AND aspect >= 12 AS sliver, least(w, h) > 0 AND least(w, h) <= 2.5 AND area >= 20 AS corridor FROM b),
g AS (SELECT m.*, spike >= 0.74 AND aspect >= 20 AS needle, items.code IS NOT NULL AS matched, coalesce(missing, 0) AS missing, def_fill FROM m LEFT JOIN items ON items.collection_id = m.collection_id AND items.code = target_code LEFT JOIN defs ON defs.collection_id = m.collection_id AND defs.code = target_code),
x AS (SELECT *, spike >= 0.74 OR needle OR sliver OR corridor OR holed AS artifact FROM g)"""


def _features(spark, sf_dir):
    rows = e.shape_metrics(_profile(spark, sf_dir)).withColumn("style_hex", F.col("fill_hex")).withColumn("type_text", F.lit(None).cast("string"))
    small = (F.col("holes") > 0) & ((F.col("w") * F.col("h") / 4 <= 35) | (F.least("w", "h") / 2 <= 2.5))
    rows = rows.withColumn("void_review", small.cast("int")).withColumn("hole_review", ((F.col("holes") > 0) & ~small).cast("int")).withColumn("islands", F.lit(0))
    return rows.withColumn("target_code", F.when(F.col("drawing_index") % 4 == 0, "BI").when(F.col("drawing_index") % 4 == 1, "SX"))


def _found(spark, sf_dir):
    """Those columns of the features that annotation and counts read, written for a query that reads them twice."""
    of = ["collection_id", "drawing_index", "style_hex", "stroke_hex", "area", "spike", "needle", "sliver", "corridor", "void_review", "hole_review", "islands", "type_text", "target_code"]
    return written(_features(spark, sf_dir).select(*of), "features")


def _annotated(spark, sf_dir, features=None):
    known = view(spark, sf_dir, "v_features")
    items = known.groupBy("collection_id").agg((F.count("*") % 2).alias("missing")).withColumn("code", F.lit("BI"))
    defs = known.where("style_hex <> '#ffffff'").groupBy("collection_id").agg(F.min("style_hex").alias("def_fill")).withColumn("code", F.lit("BI")).withColumn("nth", F.lit(1)).withColumn("def_stroke", F.lit(None).cast("string"))
    return an.annotate(_features(spark, sf_dir) if features is None else features, items, defs)


@query("i7_annotated_features", FOUND + """ SELECT collection_id, CASE WHEN artifact OR white THEN 'artifact_requires_review' ELSE 'requires_review' END AS status, coalesce(target_code, 'UNMAPPED') AS proposed_class,
CASE WHEN artifact OR white THEN 'Blocked: geometry artifact candidate requires human review before export' WHEN missing > 0 THEN 'Blocked: matched legend item ' || target_code || ' is missing STAV/NAVRH symbol confirmation'
  WHEN target_code IS NOT NULL THEN 'Blocked: proposed mapping ' || target_code || ' needs explicit human approval' ELSE 'Blocked: no legend match or proposal evidence available' END AS reason,
concat_ws(',', CASE WHEN artifact THEN 'artifact_requires_review' END, CASE WHEN needle THEN 'needle_spike_candidate' END, CASE WHEN sliver THEN 'sliver_component_candidate' END, CASE WHEN corridor THEN 'thin_corridor_candidate' END,
  CASE WHEN holed AND NOT small THEN 'unknown_hole_review_required' END, CASE WHEN small THEN 'void_artifact_candidate' END, CASE WHEN white THEN 'white_fill_candidate' END) AS flags,
count(*) AS n, CAST(sum(needle::INT + sliver::INT + corridor::INT + holed::INT) AS BIGINT) AS artifacts FROM x GROUP BY ALL""", BOTH)  # fmt: skip
def _i7(spark, sf_dir):
    rows = _annotated(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))
    return rows.groupBy("collection_id", "status", "proposed_class", F.col("export_blocking_reason").alias("reason"), "flags").agg(F.count("*").alias("n"), F.sum("artifact_count").alias("artifacts"))


@query("i8_display_colors", FOUND + """ SELECT collection_id, CASE WHEN fill_hex IS NOT NULL AND NOT white THEN fill_hex WHEN def_fill IS NOT NULL THEN def_fill WHEN target_code = 'BI' THEN '#d9483f' WHEN target_code = 'SX' THEN '#bb8fce' ELSE '#9ca3af' END AS display_fill,
CASE WHEN fill_hex IS NOT NULL AND NOT white THEN 'source_style' WHEN def_fill IS NOT NULL THEN 'legend_symbol' WHEN target_code IS NOT NULL THEN 'proposed_class' ELSE 'fallback_unmapped' END AS display_source, coalesce(stroke_hex, '#222222') AS display_stroke, count(*) AS n FROM x GROUP BY ALL""", BOTH)  # fmt: skip
def _i8(spark, sf_dir):
    return _annotated(spark, sf_dir).groupBy("collection_id", "display_fill", "display_source", "display_stroke").agg(F.count("*").alias("n"))


@query("i9_artifact_diagnostics", FOUND + """ SELECT collection_id, count(*) AS fragments, count(*) FILTER (white) AS white_fragments, CAST(coalesce(sum(CAST(area AS DECIMAL(18,3))) FILTER (white), 0) AS DECIMAL(18,3)) AS white_area, count(*) FILTER (white) AS trusted_white, round(max(spike), 4) AS max_spike,
count(*) FILTER (spike >= 0.55) AS spikes, count(*) FILTER (needle) AS needles, count(*) FILTER (sliver) AS slivers, count(*) FILTER (corridor) AS corridors, count(*) FILTER (needle) AS spike_reviews, count(*) FILTER (artifact) AS artifact_reviews, count(*) AS export_blocked FROM x GROUP BY collection_id""", BOTH)  # fmt: skip
def _i9(spark, sf_dir):
    rows = _found(spark, sf_dir)
    return an.artifact_diagnostics(rows, _annotated(spark, sf_dir, rows))


@query("i9_visual_artifacts", FOUND + """, k AS (SELECT collection_id, count(*) FILTER (white) AS white_fragments, CAST(coalesce(sum(CAST(outer_area AS DECIMAL(18,3))) FILTER (white), 0) AS DECIMAL(18,3)) AS white_area, count(*) FILTER (white AND w * h >= 1020000) AS background_masks, count(*) FILTER (white) AS trusted_white,
round(max(spike), 4) AS max_spike, count(*) FILTER (spike >= 0.55) AS spikes, count(*) FILTER (needle) AS spike_reviews, count(*) FILTER (needle) AS needles, count(*) FILTER (sliver) AS slivers, count(*) FILTER (corridor) AS corridors, count(*) FILTER (small) AS small_voids, count(*) FILTER (small) AS void_reviews,
count(*) AS export_blocked, count(*) FILTER (artifact) AS artifact_reviews, count(*) FILTER (holed) AS holes, CAST(coalesce(sum(CAST(w * h / 4 AS DECIMAL(18,3))) FILTER (holed), 0) AS DECIMAL(18,3)) AS rect_area, sum(CAST(area AS DECIMAL(18,3))) AS total,
count(*) FILTER (small) AS hatch_grids, count(*) FILTER (holed AND NOT small) AS unknown_holes FROM x GROUP BY collection_id),
r AS (SELECT *, rect_area::DOUBLE / greatest((total + rect_area)::DOUBLE, 1) AS ratio FROM k)
SELECT * EXCLUDE (total, ratio), 0 AS triangular_voids, holes AS rectangular, round(ratio, 6) AS rect_ratio, round(ratio, 6) AS void_ratio, CASE WHEN ratio >= 0.025 THEN holes ELSE 0 END AS rect_reviews, hatch_grids AS removed_holes, hatch_grids AS cleaned_candidates, unknown_holes AS hole_reviews,
0 AS label_masks, 0 AS white_backgrounds, 0 AS real_voids, CASE WHEN void_reviews > 0 THEN 'requires_plan_visual_review' ELSE 'not_applicable' END AS void_matches_plan, CASE WHEN holes > 0 THEN 'interior_ring_from_merged_fill' END AS void_source FROM r""", BOTH)  # fmt: skip
def _i9_whole(spark, sf_dir):
    return an.visual_artifacts(_roles(spark, sf_dir).withColumn("style_hex", F.col("fill_hex")), _annotated(spark, sf_dir), ["collection_id", "drawing_index"])


METHOD = FOUND + """, y AS (SELECT *, (white OR coalesce(stroke_hex = '#ffffff', false)) AND (area <= 250 OR least(w, h) <= 4) AS hatch, coalesce(fill_hex = '#000000' OR stroke_hex = '#222222', false) AS black FROM x),
z AS (SELECT collection_id, count(*) AS objects, count(*) FILTER (hatch) AS hatches, count(*) FILTER (black AND area <= 180 AND greatest(w, h) <= 20) AS dots, count(*) FILTER (black AND (coalesce(stroke_width, 0) >= 1.8 OR least(w, h) <= 3) AND area <= 1200) AS thick,
  count(*) FILTER (small) AS hatch_holes, count(*) FILTER (target_code IS NOT NULL) AS anchors FROM y GROUP BY collection_id)"""


def _profiles(features):
    more = [F.sum("void_review").alias("hatch_holes"), F.count("target_code").alias("anchors"), F.count("*").alias("primary"), F.lit(0).alias("legends"), F.count("*").alias("blocked")]
    return an.extraction_profile(an.method_counts(features, *more))


@query("i10_extraction_methods", METHOD + """ SELECT collection_id, objects, hatches, dots, thick, hatches + hatch_holes > 0 OR dots > 0 OR thick > 0 AS manual_split, 'blocked' AS export_status, unnest(['fill_style_polygonization', 'hatch_pattern_segmentation', 'dotted_boundary_segmentation', 'thick_line_boundary_segmentation', 'text_anchor_region_assignment', 'legend_style_mapping', 'raster_assisted_segmentation', 'manual_split_required']) AS method,
unnest(['used', CASE WHEN hatches + hatch_holes > 0 THEN 'manual_required' ELSE 'not_attempted' END, CASE WHEN dots > 0 THEN 'manual_required' ELSE 'not_attempted' END, CASE WHEN thick > 0 THEN 'review_required' ELSE 'not_attempted' END, CASE WHEN anchors > 0 THEN 'used' ELSE 'not_attempted' END, 'review_required', 'attempted', 'manual_required']) AS status,
unnest([objects, hatches + hatch_holes, dots, thick, anchors, 0, 0, objects]) AS evidence FROM z""", BOTH)  # fmt: skip
def _i10(spark, sf_dir):
    rows = _profiles(_features(spark, sf_dir)).select("collection_id", "objects", "hatches", "dots", "thick", "manual_split", "export_status", F.explode("methods").alias("m"))
    return rows.select("collection_id", "objects", "hatches", "dots", "thick", "manual_split", "export_status", "m.method", "m.status", "m.evidence")


@query("i11_attached_profile", METHOD + """ SELECT x.collection_id, target_code IS NOT NULL AND (hatches + hatch_holes > 0 OR dots > 0 OR thick > 0) AS manual_split_required, 'fill_style_polygonization' || CASE WHEN anchors > 0 THEN ',text_anchor_region_assignment' ELSE '' END AS methods_used, count(*) AS n FROM x JOIN z USING (collection_id) GROUP BY ALL""", BOTH)
def _i11(spark, sf_dir):
    rows = an.attach_profile(_annotated(spark, sf_dir), _profiles(_features(spark, sf_dir))).withColumn("methods_used", F.array_join("methods_used", ","))
    return rows.groupBy("collection_id", "manual_split_required", "methods_used").agg(F.count("*").alias("n"))


STYLED = SYMBOLS + """, w AS (SELECT collection_id, code, span_index, role, greatest(40.0::DOUBLE, cx - half) - 10 AS a0, greatest(600.0::DOUBLE, cy - 19) - 8 AS b0, least(300.0::DOUBLE, cx + half) + 10 AS a1, least(1300.0::DOUBLE, cy + 21) + 8 AS b1 FROM y),
p AS (SELECT w.*, f.drawing_index, f.fill_hex, f.stroke_hex FROM w LEFT JOIN v_fragments f ON f.collection_id = w.collection_id AND least(f.x0 + f.w, a1) > greatest(f.x0, a0) AND least(f.y0 + f.h, b1) > greatest(f.y0, b0)),
fi AS (SELECT collection_id, code, span_index, fill_hex FROM p WHERE fill_hex NOT IN ('#ffffff', '#000000') GROUP BY collection_id, code, span_index, fill_hex QUALIFY row_number() OVER (PARTITION BY collection_id, code, span_index ORDER BY count(*) DESC, min(drawing_index)) = 1),
st AS (SELECT collection_id, code, span_index, stroke_hex FROM p WHERE stroke_hex <> '#ffffff' GROUP BY collection_id, code, span_index, stroke_hex QUALIFY row_number() OVER (PARTITION BY collection_id, code, span_index ORDER BY count(*) DESC, min(drawing_index)) = 1),
d AS (SELECT p.collection_id, p.code, p.span_index, p.role, count(p.drawing_index) AS near, any_value(fi.fill_hex) AS symbol_fill, any_value(st.stroke_hex) AS symbol_stroke FROM p LEFT JOIN fi USING (collection_id, code, span_index) LEFT JOIN st USING (collection_id, code, span_index) GROUP BY ALL)"""
SPANS = ("v_spans", "v_fragments")


def _styled(spark, sf_dir):
    return an.dominant_styles(lg.legend_symbols(view(spark, sf_dir, "v_spans"), LEGEND), view(spark, sf_dir, "v_fragments", number=False), order=ORDER)


@query("f9_dominant_styles", STYLED + " SELECT * FROM d", SPANS)
def _f9(spark, sf_dir):
    return _styled(spark, sf_dir).select("collection_id", "code", "span_index", "role", "near", "symbol_fill", "symbol_stroke")


@query("f11_legend_definitions", STYLED + """ SELECT collection_id, code, role, CASE role WHEN 'stav_stabil' THEN 1 ELSE 2 END AS nth, 'RZVP' AS layer, code AS class, CASE role WHEN 'stav_stabil' THEN 'STAV' ELSE 'NAVRH' END AS type, symbol_fill AS def_fill, symbol_stroke AS def_stroke,
CASE WHEN symbol_fill IS NULL THEN 0.45::DOUBLE ELSE 0.72::DOUBLE END AS confidence, 'unreviewed' AS review_status FROM d WHERE role <> 'ignored_extra'""", SPANS)  # fmt: skip
def _f11(spark, sf_dir):
    return an.legend_definitions(_styled(spark, sf_dir))


ITEMS = SYMBOLS + ", k AS (SELECT collection_id, code, count(*) FILTER (role = 'stav_stabil') AS s, count(*) FILTER (role = 'navrh') AS n, count(*) FILTER (role = 'ignored_extra') AS extras FROM y GROUP BY ALL)"


@query("f10_missing_symbols", ITEMS.replace("cx BETWEEN 40 AND 300", "cx BETWEEN 40 AND 190") + """, r AS (SELECT collection_id, code, 'stav_stabil' AS role, 1 AS symbol_order FROM k WHERE s = 0 UNION ALL SELECT collection_id, code, 'navrh', 2 FROM k WHERE n = 0)
SELECT *, 'missing_expected_symbol_requires_review' AS symbol_status, 'missing-symbol-' || code || '-' || role AS task_id, code || ' has no ' || role || ' symbol in the legend' AS reason FROM r""", ("v_spans",))  # fmt: skip
def _f10(spark, sf_dir):
    """A narrow legend, so that some rows lack a symbol."""
    return an.missing_symbols(lg.legend_items(lg.legend_symbols(view(spark, sf_dir, "v_spans"), (40.0, 600.0, 190.0, 1300.0))))


@query("f12_legend_totals", ITEMS + " SELECT collection_id, count(*) AS items, count(*) FILTER (s > 0 AND n > 0) AS pairs, CAST(sum((s = 0)::INT + (n = 0)::INT) AS BIGINT) AS missing, CAST(sum(extras) AS BIGINT) AS extras FROM k GROUP BY collection_id", ("v_spans",))
def _f12(spark, sf_dir):
    return an.legend_totals(lg.legend_items(lg.legend_symbols(view(spark, sf_dir, "v_spans"), LEGEND)))
