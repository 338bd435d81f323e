"""Queries on evidence, artifacts, remapping and reviews, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles as s
from ..operators import anchors, dissolve
from ..operators import documents as d
from ..operators import evidence as e
from .catalogue import AREA, CODED, DASHED, FRAGMENTS, LEGEND, METRICS, ROLES, SHAPE, TYPED, _profile, _roles, query
from .views import view

FEATURES, EVENTS = ("v_features",), ("v_review_events",)


@query("b6_box_union", SHAPE + " SELECT collection_id, fill_hex, sum(CAST(((x0 + w) - x0) * ((y0 + h) - y0) AS DECIMAL(18,3))) AS box_area, round(min(x0) - 12, 3) AS x0, round(min(y0) - 12, 3) AS y0, round(max(x0 + w) + 12, 3) AS x1, round(max(y0 + h) + 12, 3) AS y1 FROM f GROUP BY collection_id, fill_hex", FRAGMENTS)
def _b6(spark, sf_dir):
    b, pad = F.col("bbox"), 12
    ends = [F.round(F.min(b[c]) - pad, 3).alias(c) for c in ("x0", "y0")] + [F.round(F.max(b[c]) + pad, 3).alias(c) for c in ("x1", "y1")]
    return _profile(spark, sf_dir).groupBy("collection_id", "fill_hex").agg(F.sum(g.bbox_area(b).cast(AREA)).alias("box_area"), *ends)


@query("b8_page_sides", " SELECT collection_id, count(*) FILTER (abs(x0) <= 1.5) AS at_left, count(*) FILTER (abs(x0) <= 1.5 AND abs(y0) <= 1.5 AND abs(x0 + w - 1200) <= 1.5 AND abs(y0 + h - 1700) <= 1.5) AS full_page FROM v_fragments GROUP BY collection_id", FRAGMENTS)
def _b8(spark, sf_dir):
    return view(spark, sf_dir, "v_fragments").groupBy("collection_id").agg(F.count_if(F.abs("x0") <= 1.5).alias("at_left"), F.count_if(e.full_page(*d.PAGE)).alias("full_page"))


@query(
    "c2_diagnosis",
    """, dr AS (SELECT collection_id, count(DISTINCT fill_hex) AS fills, count(DISTINCT CASE WHEN fill_hex NOT IN ('#ffffff', '#fefefe', '#fdfdfd') THEN fill_hex END) AS coloured, count(DISTINCT stroke_hex) AS strokes,
      count(*) FILTER (fill_hex = '#ffffff' AND abs(x0) <= 1.5 AND abs(y0) <= 1.5 AND abs(x0 + w - 1200) <= 1.5 AND abs(y0 + h - 1700) <= 1.5) AS backgrounds FROM v_fragments GROUP BY collection_id),
    wo AS (SELECT collection_id, count(*) FILTER (upper(substr(word, 1, 1)) IN ('Z', 'P', 'K')) AS labels FROM (SELECT collection_id, unnest(string_split_regex(raw_text, '\\s+')) AS word FROM v_spans) GROUP BY collection_id),
    pa AS (SELECT collection_id, CAST(sum(image_count) AS BIGINT) AS images FROM v_collections GROUP BY collection_id),
    al AS (SELECT pa.collection_id, images, coalesce(fills, 0) AS fills, coalesce(coloured, 0) AS coloured, coalesce(strokes, 0) AS strokes, coalesce(backgrounds, 0) AS backgrounds, coalesce(labels, 0) AS labels FROM pa LEFT JOIN dr USING (collection_id) LEFT JOIN wo USING (collection_id))
    SELECT *, backgrounds >= 1 AND coloured = 0 AND fills <= 1 AS only_background, CASE WHEN backgrounds >= 1 AND coloured = 0 AND fills <= 1 THEN 'diagnostic_only_v1' WHEN coloured > 0 THEN 'vector_fill_style_polygon_v1'
      WHEN images > 0 THEN 'raster_style_segmentation_v1' WHEN labels > 0 OR strokes > 0 THEN 'vector_text_boundary_topology_v1' ELSE 'diagnostic_only_v1' END AS algorithm FROM al""".replace("\\\\", "\\"),
    ("v_fragments", "v_spans", "v_collections"),
)
def _c2(spark, sf_dir):
    return e.diagnose(*(view(spark, sf_dir, v) for v in ("v_fragments", "v_spans", "v_collections")))


@query("c5_source_types", """ SELECT collection_id, page_index, CASE WHEN drawing_count > 0 AND image_count > 0 THEN 'mixed_pdf' WHEN drawing_count > 0 THEN 'vector_pdf' WHEN image_count > 0 THEN 'raster_pdf' ELSE 'unsupported_pdf' END AS source_type,
CASE WHEN drawing_count > 0 AND image_count > 0 THEN 0.88::DOUBLE WHEN drawing_count > 0 THEN 0.92::DOUBLE WHEN image_count > 0 THEN 0.82::DOUBLE ELSE 0.35::DOUBLE END AS confidence,
image_count > 0 AND drawing_count <= 0 AND text_span_count <= 0 AS scanned FROM v_collections""", ("v_collections",))  # fmt: skip
def _c5(spark, sf_dir):
    return e.source_type(view(spark, sf_dir, "v_collections")).select("collection_id", "page_index", "source_type", "confidence", "scanned")


@query("d7_normalized_features", " SELECT collection_id, fid, coalesce(layer, 'UNCLASSIFIED') || '.' || coalesce(class, 'UNMAPPED') AS layer_class, coalesce(class, 'UNMAPPED') || '.' || CASE upper(coalesce(type_text, '')) WHEN 'STAV' THEN '1' WHEN 'NAVRH' THEN '2' WHEN 'REZERVA' THEN '3' ELSE '0' END AS class_type FROM v_features", FEATURES)
def _d7(spark, sf_dir):
    return e.normalized(view(spark, sf_dir, "v_features")).select("collection_id", "fid", "layer_class", "class_type")


@query("e1_packed_colors", " SELECT collection_id, fill_hex, CAST('0x' || substr(fill_hex, 2, 6) AS INTEGER) AS packed, count(*) AS n FROM v_fragments WHERE fill_hex IS NOT NULL GROUP BY ALL", FRAGMENTS)
def _e1(spark, sf_dir):
    r, gr, b = s.channels(F.col("fill_hex"))
    return view(spark, sf_dir, "v_fragments").where("fill_hex is not null").groupBy("collection_id", "fill_hex", (r * 65536 + gr * 256 + b).alias("packed")).agg(F.count("*").alias("n"))


@query("e5_drawing_traces", SHAPE + f" SELECT collection_id, drawing_index, {DASHED} AS dash_norm, round(CASE WHEN holed THEN outer_area - w * h / 4 ELSE outer_area END, 6) AS area, CAST(CASE WHEN holed THEN 2 ELSE 1 END AS INTEGER) AS n_rings FROM f", FRAGMENTS)
def _e5(spark, sf_dir):
    return _profile(spark, sf_dir).select("collection_id", "drawing_index", s.dash(F.col("dashes"))["norm"].alias("dash_norm"), F.round("area", 6).alias("area"), F.size("rings").alias("n_rings"))


@query("e6_feature_definitions", """ SELECT 'vector' AS kind, collection_id, style_hex, layer, class, type_text, NULL AS text_id, count(*) AS n, min(fid) AS first_fid FROM v_features GROUP BY ALL
UNION ALL SELECT 'text', collection_id, NULL, NULL, NULL, NULL, text_id, count(*), min(fid) FROM v_features WHERE text_id IS NOT NULL GROUP BY ALL""", FEATURES)  # fmt: skip
def _e6(spark, sf_dir):
    rows, count = view(spark, sf_dir, "v_features"), [F.count("*").alias("n"), F.min("fid").alias("first_fid")]
    vector = rows.groupBy(F.lit("vector").alias("kind"), "collection_id", "style_hex", "layer", "class", "type_text").agg(*count)
    return vector.unionByName(rows.where("text_id is not null").groupBy(F.lit("text").alias("kind"), "collection_id", "text_id").agg(*count), allowMissingColumns=True)


@query("e13_definition_candidates", TYPED + """ SELECT layer, class, type_text, style_hex, style_hex IS NOT NULL AS has_fill, CASE WHEN layer = 'ZMEN' THEN 'change_label' ELSE 'definition' END AS role, type, type_score, count(*) AS n FROM y GROUP BY ALL""", FEATURES)
def _e13(spark, sf_dir):
    role = F.when(F.col("layer") == "ZMEN", "change_label").otherwise("definition").alias("role")
    rows = view(spark, sf_dir, "v_features").groupBy("layer", "class", "type_text", "style_hex", F.col("style_hex").isNotNull().alias("has_fill"), role).agg(F.count("*").alias("n"))
    return d.infer_type(rows)


@query("e14_approvals", """, a AS (SELECT target_id, max(ts) AS approved_at, count(*) AS n FROM v_review_events WHERE action = 'approve' GROUP BY target_id)
SELECT a.target_id, a.approved_at, a.n, CASE WHEN f.fid IS NULL THEN 'unknown_id' ELSE 'approved' END AS status FROM a LEFT JOIN (SELECT DISTINCT fid FROM v_features) f ON f.fid = a.target_id""", ("v_review_events", "v_features"))  # fmt: skip
def _e14(spark, sf_dir):
    said = view(spark, sf_dir, "v_review_events").where("action = 'approve'").groupBy("target_id").agg(F.max("ts").alias("approved_at"), F.count("*").alias("n"))
    known = view(spark, sf_dir, "v_features").select("fid").distinct()
    return said.join(known.hint("shuffle_hash"), said.target_id == known.fid, "left").select("target_id", "approved_at", "n", F.when(F.col("fid").isNull(), "unknown_id").otherwise("approved").alias("status"))


@query("f6_legend_rows", CODED + """, i AS (SELECT collection_id, code, median((y0 + y1) / 2) AS row_y FROM c WHERE code IS NOT NULL AND (x0 + x1) / 2 BETWEEN 40 AND 300 AND (y0 + y1) / 2 BETWEEN 600 AND 1300 GROUP BY ALL)
SELECT *, row_y - 15 AS top, least(coalesce(lead(row_y) OVER (PARTITION BY collection_id ORDER BY row_y, code), row_y + 42) - 6, row_y + 45) AS bottom FROM i""", ("v_spans",))  # fmt: skip
def _f6(spark, sf_dir):
    return e.legend_rows(view(spark, sf_dir, "v_spans"), LEGEND)


@query("h5_merge_stats", ROLES + """, g AS (SELECT collection_id, fill_hex, stroke_hex, count(*) AS fragments, sum(CAST(area AS DECIMAL(18,3))) AS area FROM o WHERE role IN ('area_fill_candidate', 'tessellated_area_fragment') AND region = 'map_body_region' GROUP BY ALL HAVING count(*) >= 2)
SELECT *, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY fragments DESC, fill_hex NULLS FIRST, stroke_hex NULLS FIRST) AS INTEGER) AS fid FROM g""", FRAGMENTS)  # fmt: skip
def _h5(spark, sf_dir):
    order = Window.partitionBy("collection_id").orderBy(F.desc("n"), F.asc_nulls_first("fill_hex"), F.asc_nulls_first("stroke_hex"))
    return d.merge_groups(_roles(spark, sf_dir)).withColumn("fid", F.row_number().over(order)).withColumnRenamed("n", "fragments")


@query("h4_dissolve", """, t AS (SELECT DISTINCT collection_id, fill_hex, x0, y0 FROM v_tiles),
p AS (SELECT t.collection_id, t.fill_hex, count(*) AS pairs FROM t JOIN t n ON n.collection_id = t.collection_id AND n.fill_hex IS NOT DISTINCT FROM t.fill_hex AND ((n.x0 = t.x0 + 4 AND n.y0 = t.y0) OR (n.x0 = t.x0 AND n.y0 = t.y0 + 4)) GROUP BY ALL),
s AS (SELECT collection_id, fill_hex, count(*) AS tiles FROM t GROUP BY ALL)
SELECT s.collection_id, s.fill_hex, CAST(tiles * 16 AS DECIMAL(18,3)) AS area, CAST(tiles * 16 - coalesce(pairs, 0) * 8 AS DECIMAL(18,3)) AS perimeter FROM s LEFT JOIN p ON p.collection_id = s.collection_id AND p.fill_hex IS NOT DISTINCT FROM s.fill_hex""", ("v_tiles",))  # fmt: skip
def _h4(spark, sf_dir):
    """Tiles of a grid, some of them several times: the union's area and the length of its borders, holes included."""
    t = view(spark, sf_dir, "v_tiles")
    corner = lambda dx, dy: g.point(F.col("x0") + dx, F.col("y0") + dy)
    ring = F.array(corner(0.0, 0.0), corner(4.0, 0.0), corner(4.0, 4.0), corner(0.0, 4.0), corner(0.0, 0.0))
    rows = dissolve.dissolve(t.select("collection_id", "fill_hex", F.array(ring).alias("rings")), ["collection_id", "fill_hex"], least_area=0.0)
    border = F.aggregate(F.transform("rings", g.ring_perimeter), F.lit(0.0), lambda s, x: s + x)
    return rows.groupBy("collection_id", "fill_hex").agg(F.sum(F.col("area").cast(AREA)).cast(AREA).alias("area"), F.sum(border.cast(AREA)).cast(AREA).alias("perimeter"))


@query("h7_quality_gate", METRICS + ", p AS (SELECT collection_id, count(DISTINCT concat(coalesce(fill_hex, '-'), coalesce(stroke_hex, '-'))) AS groups FROM r GROUP BY collection_id) SELECT collection_id, n AS raw, groups AS primary_features, detected AND groups >= n AS warn FROM mm JOIN p USING (collection_id)", FRAGMENTS)
def _h7(spark, sf_dir):
    rows = view(spark, sf_dir, "v_fragments")
    groups = rows.groupBy("collection_id").agg(F.count_distinct(F.concat(F.coalesce("fill_hex", F.lit("-")), F.coalesce("stroke_hex", F.lit("-")))).alias("groups"))
    return d.tessellation_metrics(rows, least=1000).join(groups, "collection_id").select("collection_id", F.col("n").alias("raw"), F.col("groups").alias("primary_features"), (F.col("detected") & (F.col("groups") >= F.col("n"))).alias("warn"))


@query(
    "i1_shape_metrics",
    SHAPE + """, a AS (SELECT *, CASE WHEN holed THEN outer_area - w * h / 4 ELSE outer_area END AS area, CASE WHEN shape = 'tri' THEN w + h + sqrt(w * w + h * h) ELSE 2 * (w + h) END AS per, CASE WHEN shape = 'tri' THEN 3 ELSE 4 END AS v FROM f),
    b AS (SELECT *, greatest(w, h) / greatest(least(w, h), 1e-9) AS aspect, 4 * pi() * area / (per * per) AS compactness, v / sqrt(greatest(area, 1.0::DOUBLE)) AS complexity FROM a)
    SELECT collection_id, drawing_index, round(aspect, 6) AS aspect, round(compactness, 6) AS compactness, round(0.35::DOUBLE * least(aspect / 30, 1) + 0.2::DOUBLE * (1 - least(compactness / 0.18::DOUBLE, 1)) + 0.15::DOUBLE * least(complexity / 18, 1), 6) AS spike FROM b""",
    FRAGMENTS,
)
def _i1(spark, sf_dir):
    return e.shape_metrics(_profile(spark, sf_dir)).select("collection_id", "drawing_index", *[F.round(c, 6).alias(c) for c in ("aspect", "compactness", "spike")])


@query(
    "i3_hole_classes",
    SHAPE + """, o AS (SELECT collection_id, CASE WHEN w * h / 4 <= 35 OR least(w / 2, h / 2) <= 2.5 THEN 'hatch_grid_artifact' ELSE 'unknown_review_required' END AS hole_class, w * h / 4 AS hole_area FROM f WHERE holed)
    SELECT collection_id, hole_class, count(*) AS n, sum(CAST(hole_area AS DECIMAL(18,3))) AS area FROM o GROUP BY ALL""",
    FRAGMENTS,
)
def _i3(spark, sf_dir):
    """Holes here are rectangles of a quarter or half of their polygon, so only two classes occur."""
    return e.hole_classes(d.rings(view(spark, sf_dir, "v_fragments"))).groupBy("collection_id", "hole_class").agg(F.count("*").alias("n"), F.sum(F.col("hole_area").cast(AREA)).alias("area"))


BY_CODE = "CASE {c} WHEN 'B' THEN 'BYDLENI' WHEN 'BI' THEN 'BYDLENI' WHEN 'BV' THEN 'BYDLENI' WHEN 'BH' THEN 'BYDLENI' WHEN 'BU' THEN 'BYDLENI' WHEN 'BX.c' THEN 'BYDLENI' WHEN 'BX.p' THEN 'BYDLENI' WHEN 'BX.r' THEN 'BYDLENI' WHEN 'R' THEN 'REKREACE' WHEN 'RI' THEN 'REKREACE' WHEN 'RX' THEN 'REKREACE' WHEN '{n}' THEN NULL ELSE CASE WHEN {c} IS NOT NULL THEN 'SMISENE_OBYTNE' END END"
PROPOSED = CODED + """, t1 AS (SELECT collection_id, arg_min(code, span_index) AS near_code FROM c WHERE code IS NOT NULL GROUP BY collection_id),
k AS (SELECT f.collection_id, class, style_hex, count(*) AS n FROM v_features f GROUP BY ALL),
j AS (SELECT k.*, CASE WHEN class IN ('BI', 'SV', 'BX.c', 'RI') THEN class END AS own, CASE WHEN class IS NULL OR class IN ('X', 'QQ') THEN near_code END AS near FROM k LEFT JOIN t1 USING (collection_id)),
pr AS (SELECT *, own IS NULL AND near IS NULL AS none, own IS NOT NULL AND near IS NOT NULL AND own <> near AS clash, style_hex IS NULL AS dashed FROM j),
cl AS (SELECT collection_id, class, style_hex, n, CASE WHEN NOT none AND NOT clash THEN """ + BY_CODE.format(c="coalesce(own, near)", n="") + """ ELSE 'UNMAPPED' END AS proposed_class,
CASE WHEN none THEN CASE WHEN style_hex IS NOT NULL THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END WHEN clash THEN 0.24::DOUBLE ELSE least(0.98::DOUBLE, CASE WHEN own IS NOT NULL THEN 0.92::DOUBLE ELSE 0.86::DOUBLE END - CASE WHEN dashed THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END) END AS confidence,
none OR clash OR dashed OR (own IS NOT NULL AND near IS NULL) AS review FROM pr)"""  # fmt: skip


def _proposals(spark, sf_dir):
    """Definitions with the first code text of their collection beside those without a class of their own."""
    first = d.text_specs(view(spark, sf_dir, "v_spans")).where("code is not null").groupBy("collection_id").agg(F.min_by("text", "span_index").alias("first"))
    rows = view(spark, sf_dir, "v_features").groupBy("collection_id", "class", "style_hex").agg(F.count("*").alias("n")).join(first, "collection_id", "left")
    rows = rows.withColumn("near_text", F.when(F.col("class").isNull() | F.col("class").isin("X", "QQ"), F.col("first"))).withColumn("fill_hex", F.col("style_hex")).withColumn("stroke_hex", F.lit(None).cast("string"))
    rows = rows.withColumn("dash_norm", F.when(F.col("style_hex").isNull(), "4,2;phase=0").otherwise("solid"))
    return e.classify_evidence(rows, {"class": 0.92, "near_text": 0.86})


@query("j3_classification_proposals", PROPOSED + " SELECT * FROM cl", ("v_spans", "v_features"))
def _j3(spark, sf_dir):
    return _proposals(spark, sf_dir).select("collection_id", "class", "style_hex", "n", "proposed_class", "confidence", "review")


@query("j10_scope_counts", PROPOSED + " SELECT collection_id, count(*) FILTER (proposed_class <> 'UNMAPPED') AS in_scope, count(*) FILTER (review) AS to_review FROM cl GROUP BY collection_id", ("v_spans", "v_features"))
def _j10(spark, sf_dir):
    return _proposals(spark, sf_dir).groupBy("collection_id").agg(F.count_if(F.col("proposed_class") != "UNMAPPED").alias("in_scope"), F.count_if("review").alias("to_review"))


# The part of the class vocabulary that the test tables use.
CLASSES = [("RZVP.BI", "Bydlení individuální"), ("RZVP.SV", "Smíšené obytné venkovské"), ("RZVP.RI", "Rekreace individuální"), ("ZMEN.Z", "Zastavitelná plocha"), ("ZMEN.K", "Plocha změn v krajině"), ("CUST.X", "Specifické")]
# End of fixed values.
CLASS_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in CLASSES)


@query(
    "j6_remap",
    TYPED + f""", v(layer_class, label) AS (VALUES {CLASS_ROWS}), q AS (SELECT DISTINCT layer, class, type_text, text_id AS ref, type, type_score, layer || '.' || coalesce(class, 'UNMAPPED') AS layer_class FROM y), l AS (SELECT q.*, label, starts_with(q.layer_class, 'CUST.') AS custom FROM q LEFT JOIN v USING (layer_class))
    SELECT layer, class, type_text, ref, type, CASE WHEN label IS NOT NULL OR (custom AND ref IS NOT NULL) THEN coalesce(class, 'UNMAPPED') ELSE 'UNMAPPED' END AS proposed_class,
    CASE WHEN label IS NOT NULL AND ref IS NOT NULL THEN label || ' (' || ref || ')' WHEN label IS NOT NULL THEN label WHEN custom AND ref IS NOT NULL THEN layer_class || ' - ' || ref END AS display_label,
    CASE WHEN label IS NOT NULL THEN least(0.96::DOUBLE, 0.75::DOUBLE + type_score / 4) WHEN custom AND ref IS NOT NULL THEN 0.78::DOUBLE ELSE type_score / 2 END AS score,
    CASE WHEN label IS NOT NULL THEN type_score < 0.8::DOUBLE OR (custom AND ref IS NULL) WHEN custom AND ref IS NOT NULL THEN type_score < 0.8::DOUBLE ELSE true END AS review FROM l""",
    FEATURES,
)
def _j6(spark, sf_dir):
    rows = view(spark, sf_dir, "v_features").withColumn("ref", F.col("text_id"))
    return e.remap(rows, spark.createDataFrame(CLASSES, "layer_class string, label string")).select("layer", "class", "type_text", "ref", "type", "proposed_class", "display_label", "score", "review")


EVIDENCE = """, w0 AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN greatest(w, h) / greatest(least(w, h), 1e-6) ELSE 0 END AS aspect, coalesce(fill_hex = '#ffffff', false) AS wf, coalesce(stroke_hex = '#ffffff', false) AS ws,
coalesce(fill_hex = '#000000', false) OR coalesce(stroke_hex = '#222222', false) AS black FROM v_fragments),
ev AS (SELECT *, CASE WHEN black AND w <= 22 AND h <= 22 AND w * h <= 220 THEN 'dotted_boundary_dot' WHEN black AND (stroke_width >= 1.8 OR least(w, h) <= 3 OR aspect >= 8) THEN 'thick_boundary_line'
WHEN ws AND stroke_width <= 1.2 AND aspect >= 4 THEN 'hatch_line' WHEN wf AND w * h <= 5000 THEN 'label_mask' WHEN fill_hex IN ('#ff0000', '#d9483f') THEN 'fill_region' ELSE 'unknown' END AS evidence FROM w0)"""


def _evidence(spark, sf_dir):
    return e.evidence_index(view(spark, sf_dir, "v_fragments"))


@query("k1_evidence_index", EVIDENCE + " SELECT collection_id, drawing_index, evidence FROM ev", FRAGMENTS)
def _k1(spark, sf_dir):
    return _evidence(spark, sf_dir).select("collection_id", "drawing_index", "evidence")


@query("k1_evidence_records", EVIDENCE + """, s AS (SELECT *, trim(raw_text) AS t FROM v_spans), m AS (SELECT *, nullif(regexp_extract(t, '(?i)\\b(BX[.\\s-]?[pc]|Z[.\\s-]?\\d+[a-z]?)\\b'), '') AS hit FROM s)
SELECT collection_id, 'drawing' AS source, printf('draw-%06d', drawing_index) AS evidence_id, drawing_index AS z_order, 1 AS page_number, x0, y0, x0 + w AS x1, y0 + h AS y1, CASE WHEN fill_hex IS NOT NULL OR shape = 'rect' THEN 'closed_path' ELSE 'open_path' END AS geometry_type,
CASE shape WHEN 'rect' THEN 're' ELSE 'l' END AS operation, fill_hex, stroke_hex, round(stroke_width, 4) AS stroke_width, coalesce(dashes, 'solid') AS dash_pattern, fill_hex IS NOT NULL OR shape = 'rect' AS closed, fill_hex IS NULL AND shape <> 'rect' AND (stroke_hex IS NOT NULL OR stroke_width <> 0) AS open,
NULL AS text, evidence, NULL AS normalized_label FROM ev
UNION ALL SELECT collection_id, 'text', printf('text-%06d', span_index), span_index, 1, x0, y0, x1, y1, 'text', 'text_span', CASE WHEN span_index % 3 = 0 THEN '#222222' END, NULL, NULL, NULL, false, false, raw_text, CASE WHEN hit IS NULL THEN 'unknown' ELSE 'text_anchor' END,
CASE WHEN hit = 'BX p' THEN 'BX.p' ELSE hit END FROM m""", ("v_fragments", "v_spans"))  # fmt: skip
def _k1_whole(spark, sf_dir):
    drawn = _evidence(spark, sf_dir).withColumn("operations", F.when(F.col("shape") == "rect", "re").otherwise("l")).withColumn("page_number", F.lit(1))
    texts = view(spark, sf_dir, "v_spans").withColumn("color_hex", F.when(F.col("span_index") % 3 == 0, "#222222")).withColumn("page_number", F.lit(1))
    return anchors.evidence_records(drawn, anchors.text_anchors(texts))


@query("k3_evidence_summary", EVIDENCE + """, nn AS (SELECT *, row_number() OVER (PARTITION BY collection_id, evidence ORDER BY drawing_index) AS k FROM ev)
SELECT collection_id, evidence, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN CAST(drawing_index AS VARCHAR) END, ',' ORDER BY drawing_index) AS samples FROM nn GROUP BY ALL""", FRAGMENTS)  # fmt: skip
def _k3(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("collection_id", "evidence").orderBy("drawing_index"))
    sample = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.col("drawing_index")))), lambda x: x.cast("string")), ",")
    return _evidence(spark, sf_dir).withColumn("k", nth).groupBy("collection_id", "evidence").agg(F.count("*").alias("n"), sample.alias("samples"))


@query("k5_roi_evidence", EVIDENCE + """, roi AS (SELECT collection_id, min(x0) - 80 AS rx0, min(y0) - 80 AS ry0, max(x0 + w) + 80 AS rx1, max(y0 + h) + 80 AS ry1 FROM v_fragments WHERE fill_hex = '#d9483f' AND x0 < 300 AND y0 < 400 GROUP BY collection_id)
SELECT ev.collection_id, evidence, count(*) AS n FROM ev JOIN roi USING (collection_id) WHERE x0 <= rx1 AND x0 + w >= rx0 AND y0 <= ry1 AND y0 + h >= ry0 GROUP BY ALL""", FRAGMENTS)  # fmt: skip
def _k5(spark, sf_dir):
    rows = _evidence(spark, sf_dir)
    roi = e.region_of_interest(rows.where("fill_hex = '#d9483f' and x0 < 300 and y0 < 400"))
    inside = "x0 <= rx1 and x0 + w >= rx0 and y0 <= ry1 and y0 + h >= ry0"
    return rows.join(roi, "collection_id").where(inside).groupBy("collection_id", "evidence").agg(F.count("*").alias("n"))


def _latest_sql(action: str) -> str:
    return f""" SELECT collection_id, target_id, n, event_id, note_json FROM (SELECT *, count(*) OVER (PARTITION BY collection_id, target_id) AS n, row_number() OVER (PARTITION BY collection_id, target_id ORDER BY ts DESC, event_id DESC) AS k
    FROM v_review_events WHERE action = '{action}' AND coalesce(trim(note_json), '') <> '') WHERE k = 1"""


@query("m2_latest_annotations", _latest_sql("annotate"), EVENTS)
def _m2(spark, sf_dir):
    return e.latest(view(spark, sf_dir, "v_review_events"), "annotate")


@query("m3_label_corrections", _latest_sql("label"), EVENTS)
def _m3(spark, sf_dir):
    return e.latest(view(spark, sf_dir, "v_review_events"), "label")


@query("j8_latest_overrides", _latest_sql("override"), EVENTS)
def _j8(spark, sf_dir):
    return e.latest(view(spark, sf_dir, "v_review_events"), "override")


@query("m5_constraint_report", """ SELECT collection_id, count(*) FILTER (layer = 'ZMEN' AND coalesce(upper(type_text), 'NAVRH') <> 'NAVRH') AS zmen_not_navrh, count(*) FILTER (layer = 'CUST' AND text_id IS NULL) AS custom_without_ref,
count(*) FILTER (layer = 'ZMEN' AND style_hex IS NOT NULL) AS zmen_filled, count(*) FILTER (upper(type_text) NOT IN ('STAV', 'NAVRH', 'REZERVA')) AS unknown_type, count(*) FILTER (class IS NULL) AS class_missing,
count(*) FILTER (coalesce(area, 0) <= 0) AS no_area FROM v_features GROUP BY collection_id""", FEATURES)  # fmt: skip
def _m5(spark, sf_dir):
    return e.constraint_report(view(spark, sf_dir, "v_features"))


@query("m7_facets", """, k AS (SELECT layer, coalesce(class, 'UNMAPPED') AS class, coalesce(type_text, 'UNMAPPED') AS type FROM v_features)
SELECT 'layer' AS facet, layer AS value, count(*) AS n FROM k GROUP BY layer UNION ALL SELECT 'class', class, count(*) FROM k WHERE layer = 'RZVP' GROUP BY class UNION ALL SELECT 'type', type, count(*) FROM k WHERE layer = 'RZVP' AND class = 'BI' GROUP BY type""", FEATURES)  # fmt: skip
def _m7(spark, sf_dir):
    return e.facets(view(spark, sf_dir, "v_features"), "RZVP", "BI")
