"""Queries on text anchors, experiment scores, legend labels and routed documents, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as a
from ..operators import documents as d
from ..operators import evidence as e
from ..operators import legends as lg
from .catalogue import CODED, LEGEND, query
from .evidence import EVIDENCE
from .records import QUALITY, SYMBOLS
from .views import view

SPANS = ("v_spans",)
BOTH = ("v_fragments", "v_spans")
#: Texts of spans with more kinds of labels than the table has.
LABELLED = """CASE span_index % 7 WHEN 0 THEN raw_text WHEN 1 THEN 'plocha z-' || span_index % 90 || 'B' WHEN 2 THEN 'bx.P/' || raw_text WHEN 3 THEN 'Plochy  Bydlení' WHEN 4 THEN 'smíšené obytné, rekreace' WHEN 5 THEN 'rekreační, Z ' || span_index % 40 ELSE 'xZ1 obytný' END"""
MATCH = rf"regexp_extract({LABELLED}, '(?i)\b(?:BX[.\s-]?[pc]|Z[.\s-]?\d+[a-z]?)\b', 0)"


def _labelled(spark, sf_dir):
    return view(spark, sf_dir, "v_spans").withColumn("raw_text", F.expr(LABELLED))


@query("k2_text_anchors", f""", m AS (SELECT collection_id, span_index, replace(replace({MATCH}, ' ', '.'), '-', '.') AS m FROM v_spans)
SELECT collection_id, span_index, CASE WHEN m = '' THEN 'unknown' ELSE 'text_anchor' END AS evidence, CASE WHEN m = '' THEN NULL WHEN lower(m[1:1]) = 'z' THEN 'Z.' || lower(regexp_replace(m, '^[zZ][.]?', '')) ELSE 'BX.' || lower(m[-1:]) END AS normalized_label FROM m""", SPANS)  # fmt: skip
def _k2(spark, sf_dir):
    return a.text_anchors(_labelled(spark, sf_dir)).select("collection_id", "span_index", "evidence", "normalized_label")


@query("e11_target_labels", rf""", n AS (SELECT collection_id, regexp_replace(lower(strip_accents(trim({LABELLED}))), '\s+', ' ', 'g') AS t FROM v_spans)
SELECT collection_id, CASE WHEN regexp_matches(t, '\bsmisene (obytne|bydleni)\b') THEN 'S' WHEN regexp_matches(t, '\bbydleni\b|\bobyt(ne|ny)\b') THEN 'B' WHEN regexp_matches(t, '\brekreac(e|ni|ny)\b') THEN 'R' END AS label, count(*) AS n FROM n GROUP BY ALL""", SPANS)  # fmt: skip
def _e11(spark, sf_dir):
    return d.text_specs(_labelled(spark, sf_dir)).groupBy("collection_id", "label").agg(F.count("*").alias("n"))


#: Profiles with few findings, by collection, so that scores differ.
PROFILED = EVIDENCE + r""", roi AS (SELECT collection_id, min(x0) - 80 AS rx0, min(y0) - 80 AS ry0, max(x0 + w) + 80 AS rx1, max(y0 + h) + 80 AS ry1 FROM v_fragments WHERE fill_hex = '#d9483f' AND x0 < 900 AND y0 < 1000 AND collection_id <> 3 GROUP BY collection_id),
an AS (SELECT *, regexp_extract(raw_text, '(?i)\b(?:BX[.\s-]?[pc]|Z[.\s-]?\d+[a-z]?)\b', 0) <> '' AS anchor FROM v_spans),
sp AS (SELECT an.collection_id, count(*) AS labels, array_to_string(list_sort(list_distinct(list(replace(raw_text, ' ', '.')))), ',') AS names FROM an JOIN roi USING (collection_id) WHERE anchor AND x0 <= rx1 AND x1 >= rx0 AND y0 <= ry1 AND y1 >= ry0 GROUP BY 1),
dr AS (SELECT ev.collection_id, count(*) FILTER (evidence = 'hatch_line') AS all_hatches, count(*) FILTER (evidence = 'hatch_line' AND x0 <= rx1 AND x0 + w >= rx0 AND y0 <= ry1 AND y0 + h >= ry0) AS roi_hatches, count(*) FILTER (evidence = 'dotted_boundary_dot') AS dots,
  count(*) FILTER (stroke_width >= 1.8 OR evidence = 'thick_boundary_line') AS thick FROM ev LEFT JOIN roi USING (collection_id) GROUP BY 1),
i AS (SELECT dr.collection_id, CASE WHEN dr.collection_id % 2 = 0 THEN all_hatches ELSE 0 END AS hatches, roi_hatches, CASE WHEN dr.collection_id = 5 THEN 7 ELSE dots END AS dots, thick, coalesce(labels, 0) AS labels, coalesce(names, '') AS names, dr.collection_id % 3 = 0 AS methods, rx0, ry0, rx1, ry1 FROM dr LEFT JOIN roi USING (collection_id) LEFT JOIN sp USING (collection_id)),
sc AS (SELECT *, (CASE WHEN hatches > 0 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN dots > 0 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN thick > 0 THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN labels > 0 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN methods THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN rx0 IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END) AS hybrid FROM i)"""


def _inputs(spark, sf_dir):
    drawn = e.evidence_index(view(spark, sf_dir, "v_fragments"))
    roi = e.region_of_interest(drawn.where("fill_hex = '#d9483f' and x0 < 900 and y0 < 1000 and collection_id <> 3"))
    hatches = F.when(F.col("collection_id") % 2 == 0, F.count_if(F.col("evidence") == "hatch_line")).otherwise(0).alias("hatches")
    profiles = drawn.groupBy("collection_id").agg(hatches, F.when(F.col("collection_id") == 5, 7).alias("dots"), F.lit(0).alias("thick"), (F.col("collection_id") % 3 == 0).alias("methods"))
    return a.experiment_inputs(a.evidence_rows(drawn, a.text_anchors(view(spark, sf_dir, "v_spans"))), roi, profiles)


def _experiment(name: str, method: str, column: str, status: str, score: float, sure: str, status_0: str, score_0: float, sure_0: str) -> str:
    pick = lambda x, y: f"CASE WHEN {column} > 0 THEN {x} ELSE {y} END"
    advice = "combine" if status_0 == "partial" else "reject"
    return f"""SELECT collection_id, '{name}' AS experiment, '{method}' AS method, {pick(f"'{status}'", f"'{status_0}'")} AS status, {pick(f"{score}::DOUBLE", f"{score_0}::DOUBLE")} AS score, {pick(f"'{sure}'", f"'{sure_0}'")} AS confidence, {pick("'combine'", f"'{advice}'")} AS advice FROM sc"""


@query("k6_experiment_scores", PROFILED + " " + " UNION ALL ".join([
    *[_experiment(*x) for x in a.EXPERIMENTS],
    f"""SELECT collection_id, 'E06', '{a.HYBRID}', CASE WHEN hybrid >= 0.65::DOUBLE THEN 'review_required' WHEN hybrid >= 0.4::DOUBLE THEN 'manual_required' ELSE 'failed' END, round(hybrid, 3), CASE WHEN hybrid >= 0.65::DOUBLE THEN 'medium' WHEN hybrid >= 0.4::DOUBLE THEN 'low' ELSE 'failed' END, CASE WHEN hybrid >= 0.4::DOUBLE THEN 'combine' ELSE 'reject' END FROM sc""",
    *[f"SELECT collection_id, '{n}', '{m}', 'success', 1.0::DOUBLE, 'high', 'keep' FROM sc" for n, m in a.CONSTANT],
]), BOTH)
def _k6(spark, sf_dir):
    return a.experiment_scores(_inputs(spark, sf_dir))


@query("k7_review_candidates", PROFILED + """ SELECT collection_id, 'review_only_semantic_split' AS candidate_type, round(hybrid, 3) AS score, rx0, ry0, rx1, ry1, false AS export_eligible FROM sc WHERE rx0 IS NOT NULL AND hybrid >= 0.65::DOUBLE""", BOTH)
def _k7(spark, sf_dir):
    at = lambda k, c: F.get("ring", F.lit(k))[c]
    return a.review_candidates(_inputs(spark, sf_dir)).select("collection_id", "candidate_type", "score", at(0, "x").alias("rx0"), at(0, "y").alias("ry0"), at(2, "x").alias("rx1"), at(2, "y").alias("ry1"), "export_eligible")


@query("k7_split_payloads", PROFILED + """, p AS (SELECT collection_id, min(fid) AS parent_fid FROM v_features WHERE class = 'BX.c' AND layer = 'RZVP' GROUP BY collection_id)
SELECT collection_id, parent_fid, names AS assigned_labels, 'E02,E03,E04,E05,E06' AS evidence_refs FROM sc LEFT JOIN p USING (collection_id)""", (*BOTH, "v_features"))  # fmt: skip
def _k7_payloads(spark, sf_dir):
    rows = a.manual_split_payloads(_inputs(spark, sf_dir), view(spark, sf_dir, "v_features").where("class = 'BX.c' and layer = 'RZVP'"))
    return rows.select("collection_id", "parent_fid", F.array_join("assigned_labels", ",").alias("assigned_labels"), F.array_join("evidence_refs", ",").alias("evidence_refs"))


#: A legend over most of the page, so that rows meet texts to their right.
WIDE = (40.0, 100.0, 1190.0, 1600.0)
LABELS = CODED + QUALITY.replace("FROM c)", "FROM lb)").replace("c.*", "lb.*").replace(", q AS", """, i AS (SELECT collection_id, code, median((y0 + y1) / 2) AS row_y FROM c WHERE code IS NOT NULL AND (x0 + x1) / 2 BETWEEN 40 AND 1190 AND (y0 + y1) / 2 BETWEEN 100 AND 1600 GROUP BY ALL),
r AS (SELECT *, row_y - 15 AS top, least(coalesce(lead(row_y) OVER (PARTITION BY collection_id ORDER BY row_y, code), row_y + 42) - 6, row_y + 45) AS bottom FROM i),
lb AS (SELECT r.collection_id, r.code, coalesce(trim(string_agg(v.raw_text, ' ' ORDER BY v.y0, v.x0, v.span_index)), '') AS text, count(DISTINCT round(v.y0, 1)) AS lines, min(v.x0) AS lx0, max(v.x1) AS lx1 FROM r LEFT JOIN v_spans v ON v.collection_id = r.collection_id AND (v.x0 + v.x1) / 2 BETWEEN 40 AND 1190 AND (v.y0 + v.y1) / 2 BETWEEN 100 AND 1600
  AND v.x0 >= 270 AND v.y0 BETWEEN greatest(top, 100) AND least(bottom, 1600) GROUP BY 1, 2), q AS""", 1)  # fmt: skip
SHOWN = """ SELECT collection_id, code, nullif(text, '') AS label, lines, lx0, lx1, CASE WHEN NOT garbled THEN regexp_replace(text, '\\s+', ' ', 'g') WHEN name IS NOT NULL THEN name ELSE 'label unreadable - review' END AS display,
CASE WHEN NOT garbled THEN 'ok' WHEN name IS NOT NULL THEN 'agent_proposed' ELSE 'manual_required' END AS status FROM q LEFT JOIN n USING (code)"""


def _labels(spark, sf_dir):
    spans = view(spark, sf_dir, "v_spans")
    return a.legend_labels(spans, e.legend_rows(spans, WIDE), WIDE)


@query("f7_legend_labels", LABELS + SHOWN, SPANS)
def _f7(spark, sf_dir):
    return _labels(spark, sf_dir).select("collection_id", "code", "label", "lines", "lx0", "lx1", "display", "status")


@query("f14_legend_proposals", LABELS + f""" SELECT collection_id, code, display AS label_text, 'RZVP' AS proposed_layer, code AS proposed_class, 0.5::DOUBLE AS confidence, 'requires_review' AS review_status, false AS export_eligible FROM ({SHOWN})""", SPANS)
def _f14(spark, sf_dir):
    return a.agent_proposals(_labels(spark, sf_dir)).select("collection_id", "code", "label_text", "proposed_layer", "proposed_class", "confidence", "review_status", "export_eligible")


@query("f15_legend_export", SYMBOLS + """, k AS (SELECT collection_id, code, count(*) FILTER (role = 'stav_stabil') > 0 AND count(*) FILTER (role = 'navrh') > 0 AS whole FROM y GROUP BY ALL),
rv AS (SELECT DISTINCT collection_id, code, collection_id % 4 <> 3 AS checked, CASE WHEN collection_id % 4 = 2 THEN 'rejected' ELSE 'approved' END AS review_status FROM c WHERE code LIKE '%S%' OR code LIKE 'B%')
SELECT collection_id, code, coalesce(review_status, 'unreviewed') AS review_status, coalesce(checked AND review_status = 'approved' AND whole, false) AS export_eligible FROM k LEFT JOIN rv USING (collection_id, code)""", SPANS)  # fmt: skip
def _f15(spark, sf_dir):
    spans = view(spark, sf_dir, "v_spans")
    seen = d.text_specs(spans).where("code like '%S%' or code like 'B%'").select("collection_id", "code").distinct()
    reviews = seen.select("collection_id", "code", (F.col("collection_id") % 4 != 3).alias("checked"), F.when(F.col("collection_id") % 4 == 2, "rejected").otherwise("approved").alias("review_status"))
    return a.export_eligible(lg.legend_items(lg.legend_symbols(spans, LEGEND)), reviews).select("collection_id", "code", "review_status", "export_eligible")


@query("f16_manual_crops", """ SELECT CASE span_index % 5 WHEN 1 THEN 'box must contain four page-coordinate numbers' WHEN 2 THEN 'box values must be numeric' WHEN 3 THEN 'box must have positive width and height' ELSE 'saved' END AS outcome, count(*) AS n, sum(CASE WHEN span_index % 5 IN (0, 4) THEN CAST(x1 - x0 AS DECIMAL(18,3)) END) AS width FROM v_spans GROUP BY 1""", SPANS)
def _f16(spark, sf_dir):
    corner = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    kind = F.col("span_index") % 5
    box = F.when(kind == 1, corner("x0", "y0", "x1")).when(kind == 2, corner("x0", "y0", "x1", "raw_text")).when(kind == 3, corner("x1", "y0", "x0", "y1")).otherwise(corner("x0", "y0", "x1", "y1"))
    crops, errors = a.manual_crops(view(spark, sf_dir, "v_spans").select(box.alias("box")))
    rows = crops.select(F.lit("saved").alias("outcome"), (F.get("box", F.lit(2)) - F.get("box", F.lit(0))).cast("decimal(18,3)").alias("width"))
    rows = rows.unionByName(errors.select(F.col("error").alias("outcome"), F.lit(None).cast("decimal(18,3)").alias("width")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


@query("b11_image_boxes", """ SELECT collection_id, span_index, (x0 - 40) * 2 AS ix0, (y0 - 600) * 2 AS iy0, (x1 - 40) * 2 AS ix1, (y1 - 600) * 2 AS iy1, x0 AS px0, y0 AS py0, x1 AS px1, y1 AS py1 FROM v_spans""", SPANS)
def _b11(spark, sf_dir):
    """Boxes to pixels of an image of the legend, and back with corners swapped."""
    crop, size = LEGEND, (520, 1400)
    rows = view(spark, sf_dir, "v_spans")
    rows = rows.withColumns(dict(zip(("ix0", "iy0", "ix1", "iy1"), a.image_box([F.col(c) for c in ("x0", "y0", "x1", "y1")], crop, size), strict=True)))
    back = a.page_box([F.col(c) for c in ("ix1", "iy0", "ix0", "iy1")], crop, size)
    return rows.select("collection_id", "span_index", "ix0", "iy0", "ix1", "iy1", *[v.alias(k) for k, v in zip(("px0", "py0", "px1", "py1"), back, strict=True)])


@query("c7_diagnostic_failures", """, dr AS (SELECT collection_id, count(DISTINCT fill_hex) FILTER (fill_hex <> '#ffffff') AS coloured, count(DISTINCT stroke_hex) AS strokes FROM v_fragments WHERE collection_id % 4 = 0 OR (collection_id % 4 = 1 AND fill_hex = '#ffffff') GROUP BY 1),
pa AS (SELECT collection_id, CASE WHEN collection_id = 2 OR collection_id = 5 THEN sum(image_count) ELSE 0 END AS images FROM v_collections GROUP BY 1), wo AS (SELECT collection_id, count(*) FILTER (upper(raw_text[1:1]) IN ('Z', 'P', 'K') OR raw_text LIKE '% p%') AS labels FROM v_spans WHERE collection_id = 6 GROUP BY 1),
al AS (SELECT collection_id, CASE WHEN coloured > 0 THEN 'vector_fill_style_polygon_v1' WHEN images > 0 THEN 'raster_style_segmentation_v1' WHEN strokes > 0 OR labels > 0 THEN 'vector_text_boundary_topology_v1' ELSE 'diagnostic_only_v1' END AS algorithm FROM pa LEFT JOIN dr USING (collection_id) LEFT JOIN wo USING (collection_id))
SELECT *, CASE algorithm WHEN 'diagnostic_only_v1' THEN 'diagnostic_only' ELSE 'algorithm_routed_pending_profile' END AS classification_status, 0 AS features FROM al WHERE algorithm <> 'vector_fill_style_polygon_v1'""", (*BOTH, "v_collections"))  # fmt: skip
def _c7(spark, sf_dir):
    """Most collections without their coloured drawings, images or texts, so that each algorithm is chosen."""
    drawn = view(spark, sf_dir, "v_fragments").where("collection_id % 4 = 0 or (collection_id % 4 = 1 and fill_hex = '#ffffff')")
    pages = view(spark, sf_dir, "v_collections").withColumn("image_count", F.when(F.col("collection_id").isin(2, 5), F.col("image_count")).otherwise(0))
    return a.diagnostic_failures(e.diagnose(drawn, view(spark, sf_dir, "v_spans").where("collection_id = 6"), pages))
