"""Text anchors and the score of a document's region of interest; labels, proposals and hand-made crops of legends; documents that are routed away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import styles as s
from . import documents as d
from .legends import label_quality

# Pattern of an anchor; experiments with status, score and confidence where their evidence is found, then where it is not, and advice.
ANCHOR = r"\b(?:BX[.\s-]?[pc]|Z[.\s-]?\d+[a-z]?)\b"
EXPERIMENTS = [
    ("E01", "vector_hatch_line_premerge_index", "roi_hatches", "partial", 0.35, "low", "failed", 0.0, "failed"),
    ("E02", "raster_hatch_grid_segmentation", "hatches", "partial", 0.62, "medium", "failed", 0.0, "failed"),
    ("E03", "dotted_boundary_reconstruction", "dots", "partial", 0.55, "low", "failed", 0.0, "failed"),
    ("E04", "thick_boundary_segmentation", "thick", "partial", 0.45, "low", "failed", 0.0, "failed"),
    ("E05", "text_anchor_constrained_assignment", "labels", "combined", 0.35, "medium", "partial", 0.15, "low"),
]
HYBRID = "hybrid_graph_constrained_polygonization"
CONSTANT = [("E07", "manual_split_fallback_schema"), ("E08", "synthetic_controls_and_regression_tests")]
WEIGHTS = [("hatches", 0.20), ("dots", 0.25), ("thick", 0.10), ("labels", 0.15), ("methods", 0.05)]
ROI_WEIGHT = 0.05
# End of fixed values.
REVIEW, MANUAL = 0.65, 0.4
LABELS_FROM = 230.0


def normalized_anchor(match: Column) -> Column:
    """``match`` as BX.p, BX.c or Z.51a; a label with other white space than blanks stays as it is."""
    raw = F.translate(match, " -", "..")
    number = F.regexp_extract(raw, r"(?i)^Z[.]?(\d+[a-z]?)$", 1)
    bx = F.regexp_replace(F.regexp_replace(raw, "(?i)BX[.]?P", "BX.p"), "(?i)BX[.]?C", "BX.c")
    return F.when(number != "", F.concat(F.lit("Z."), F.lower(number))).otherwise(bx)


def text_anchors(spans: DataFrame) -> DataFrame:
    """``spans`` with evidence (text_anchor or unknown) and normalized_label of the first anchor in raw_text; null where there is none."""
    match = F.nullif(F.regexp_extract(F.coalesce(F.trim("raw_text"), F.lit("")), "(?iU)" + ANCHOR, 0), F.lit(""))
    rows = spans.withColumn("_m", match)
    return rows.withColumn("evidence", F.when(F.col("_m").isNotNull(), "text_anchor").otherwise("unknown")).withColumn("normalized_label", normalized_anchor(F.col("_m"))).drop("_m")


def evidence_rows(drawings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Drawings (of ``evidence_index``: x0, y0, w, h) and texts (of :func:`text_anchors`: x0 to y1) as one table with source, idx, box, evidence and label."""
    x1, y1 = (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")
    drawn = drawings.select("collection_id", F.lit("drawing").alias("source"), F.col("drawing_index").alias("idx"), "x0", "y0", x1, y1, "evidence", "stroke_width", F.lit(None).cast("string").alias("normalized_label"))
    return drawn.unionByName(anchors.select("collection_id", F.lit("text").alias("source"), F.col("span_index").alias("idx"), "x0", "y0", "x1", "y1", "evidence", F.lit(None).cast("double").alias("stroke_width"), "normalized_label"))


def evidence_records(drawings: DataFrame, anchors: DataFrame) -> DataFrame:
    """The whole index: drawings (of ``evidence_index``, with operations: kinds of path items, sorted, joined by commas) and texts (of :func:`text_anchors`, with color_hex) in one table.

    A drawing is closed with a fill or a rectangle among its operations, open with a stroke otherwise. Null or empty dashes are solid, null or empty operations unknown,
    null pages page 1, null widths 0. Texts have none of a drawing's columns but the fill, which is their colour. Ids keep six digits or more.
    """
    filled, width = F.coalesce(F.col("fill_hex") != "", F.lit(False)), F.coalesce("stroke_width", F.lit(0.0))
    closed = filled | F.coalesce(F.array_contains(F.split("operations", ","), "re"), F.lit(False))
    stroked = F.coalesce(F.col("stroke_hex") != "", F.lit(False)) | (width != 0)
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    page = F.coalesce(F.col("page_number"), F.lit(1)).cast("int").alias("page_number")
    idx = lambda c, prefix: [F.format_string(f"{prefix}-%06d", F.col(c).cast("long")).alias("evidence_id"), F.col(c).cast("long").alias("z_order")]
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    drawn = drawings.select(
        "collection_id", F.lit("drawing").alias("source"), *idx("drawing_index", "draw"), page, "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"),
        F.when(closed, "closed_path").otherwise("open_path").alias("geometry_type"), given("operations", "unknown").alias("operation"), "fill_hex", "stroke_hex", F.round(width, 4).alias("stroke_width"),
        given("dashes", "solid").alias("dash_pattern"), closed.alias("closed"), (stroked & ~closed).alias("open"), none("text", "string"), "evidence", none("normalized_label", "string"),
    )
    told = anchors.select(
        "collection_id", F.lit("text").alias("source"), *idx("span_index", "text"), page, "x0", "y0", "x1", "y1", F.lit("text").alias("geometry_type"), F.lit("text_span").alias("operation"), F.col("color_hex").alias("fill_hex"),
        none("stroke_hex", "string"), none("stroke_width", "double"), none("dash_pattern", "string"), F.lit(False).alias("closed"), F.lit(False).alias("open"), F.col("raw_text").alias("text"), "evidence", "normalized_label",
    )
    return drawn.unionByName(told)


def experiment_inputs(evidence: DataFrame, roi: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per collection of ``profiles`` (hatches, dots, thick, methods boolean) with roi_hatches, labels, target_labels, has_roi and the box.

    ``evidence`` is that of :func:`evidence_rows`, ``roi`` has one row per collection or none. Null or zero dots and thick are counted from
    the evidence. Texts and drawings without a box lie in no region. Counts are aggregated before they are joined.
    """
    boxes = evidence.join(roi.hint("shuffle_hash"), "collection_id", "left")
    inside = F.coalesce((F.col("x0") <= F.col("rx1")) & (F.col("x1") >= F.col("rx0")) & (F.col("y0") <= F.col("ry1")) & (F.col("y1") >= F.col("ry0")), F.lit(False))
    role = lambda name: F.col("evidence") == name
    anchor = inside & role("text_anchor")
    seen = boxes.groupBy("collection_id").agg(
        F.count_if(inside & role("hatch_line")).alias("roi_hatches"), F.count_if(anchor).alias("labels"), F.array_sort(F.collect_set(F.when(anchor, F.col("normalized_label")))).alias("target_labels"),
        F.count_if(role("dotted_boundary_dot")).alias("_dots"), F.count_if((F.coalesce("stroke_width", F.lit(0.0)) >= 1.8) | role("thick_boundary_line")).alias("_thick"),
    )
    rows = profiles.select("collection_id", "hatches", "dots", "thick", "methods").join(seen, "collection_id", "left").join(roi, "collection_id", "left")
    rows = rows.withColumn("dots", F.coalesce(F.nullif("dots", F.lit(0)), "_dots")).withColumn("thick", F.coalesce(F.nullif("thick", F.lit(0)), "_thick"))
    rows = rows.withColumn("has_roi", F.col("rx0").isNotNull()).withColumn("target_labels", F.coalesce("target_labels", F.array().cast("array<string>")))
    return rows.na.fill(0, ["hatches", "dots", "thick", "roi_hatches", "labels"]).na.fill(False, ["methods"]).drop("_dots", "_thick")


def hybrid_score() -> Column:
    """The weights of all evidence that a row of :func:`experiment_inputs` has, added in their order."""
    total = F.lit(0.0)
    for column, weight in WEIGHTS:
        total = total + F.when(F.col(column).cast("boolean"), weight).otherwise(0.0)
    return total + F.when(F.col("has_roi"), ROI_WEIGHT).otherwise(0.0)


def experiment_scores(inputs: DataFrame) -> DataFrame:
    """Eight rows per collection of ``inputs`` (of :func:`experiment_inputs`): experiment, method, status, score, confidence and advice."""
    row = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in zip(("experiment", "method", "status", "score", "confidence", "advice"), v, strict=True)])
    out = []
    for name, method, column, *found, status, score, sure in EXPERIMENTS:
        advice = "combine" if status == "partial" else "reject"
        out.append(F.when(F.col(column) > 0, row(name, method, *found, "combine")).otherwise(row(name, method, status, score, sure, advice)))
    hybrid = F.col("_hybrid")
    grade = lambda a, b, c: F.when(hybrid >= REVIEW, a).when(hybrid >= MANUAL, b).otherwise(c)
    out.append(row("E06", HYBRID, grade("review_required", "manual_required", "failed"), F.round(hybrid, 3), grade("medium", "low", "failed"), grade("combine", "combine", "reject")))
    out += [row(name, method, "success", 1.0, "high", "keep") for name, method in CONSTANT]
    return inputs.withColumn("_hybrid", hybrid_score()).select("collection_id", F.explode(F.array(*out)).alias("e")).select("collection_id", "e.*")


def review_candidates(inputs: DataFrame) -> DataFrame:
    """The region of each collection whose hybrid score is .65 or more, as a ring, for review only."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("rx0", "ry0"), corner("rx1", "ry0"), corner("rx1", "ry1"), corner("rx0", "ry1"), corner("rx0", "ry0"))
    return inputs.where(F.col("has_roi") & (hybrid_score() >= REVIEW)).select(
        "collection_id", F.lit("review_only_semantic_split").alias("candidate_type"), F.round(hybrid_score(), 3).alias("score"), F.lit("medium").alias("confidence"),
        F.lit(True).alias("review_required"), F.lit(False).alias("export_eligible"), ring.alias("ring"),
    )


def manual_split_payloads(inputs: DataFrame, chosen: DataFrame) -> DataFrame:
    """What a reviewer starts a manual split with, one row per collection of ``inputs``: parent_fid (smallest fid of ``chosen``, null if none), labels, references."""
    parents = chosen.groupBy("collection_id").agg(F.min("fid").alias("parent_fid"))
    refs = F.array(*[F.lit(f"E0{k}") for k in range(2, 7)])
    return inputs.join(parents, "collection_id", "left").select("collection_id", "parent_fid", F.lit("manual_semantic_split").alias("correction_type"), F.col("target_labels").alias("assigned_labels"), refs.alias("evidence_refs"), F.lit(True).alias("raw_preserved"))


def legend_labels(spans: DataFrame, rows: DataFrame, legend: tuple[float, float, float, float]) -> DataFrame:
    """``rows`` (of ``legend_rows``: code, top, bottom) with the texts of their right part: label, lines, box, display, status, confidence.

    A text belongs to each row whose height holds its upper edge; texts are joined by y, x, then span_index. Rows without texts
    have a null label and no lines. A legend has at most one row per code, so a text meets few rows.
    """
    x0, y0, x1, y1 = legend
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    texts = spans.where(cx.between(x0, x1) & cy.between(y0, y1) & (F.col("x0") >= x0 + LABELS_FROM)).select("collection_id", "span_index", "raw_text", "x0", "y0", "x1", "y1")
    heights = rows.select("collection_id", "code", F.greatest("top", F.lit(y0)).alias("_top"), F.least("bottom", F.lit(y1)).alias("_end"))
    hit = texts.join(heights.hint("shuffle_hash"), "collection_id").where("y0 between _top and _end")
    part = F.struct("y0", "x0", "span_index", F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["raw_text"]), " ")
    box = [f(c).alias(f"l{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    found = hit.groupBy("collection_id", "code").agg(F.nullif(F.trim(label), F.lit("")).alias("label"), F.count_distinct(F.round("y0", 1)).alias("lines"), *box)
    out = rows.join(found, ["collection_id", "code"], "left").na.fill(0, ["lines"])
    return out.withColumn("_q", label_quality(F.col("label"), F.col("code"))).select("*", "_q.*").drop("_q")


def agent_proposals(labels: DataFrame) -> DataFrame:
    """One proposal for each row of ``labels`` with a target code: layer, class, half confidence; for review, never for export."""
    return labels.where(F.col("code").isin(*s.TARGET_CODES)).select(
        "collection_id", "code", F.col("display").alias("label_text"), F.lit("RZVP").alias("proposed_layer"), F.col("code").alias("proposed_class"), F.lit(None).cast("string").alias("proposed_type"),
        F.lit(0.5).alias("confidence"), F.lit("agent_proposed").alias("validation_status"), F.lit("requires_review").alias("review_status"), F.lit(False).alias("export_eligible"),
    )


def export_eligible(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """``items`` (of ``legend_items``) with review_status and export_eligible: checked, approved and without a missing symbol.

    ``reviews`` (collection_id, code, checked, review_status) has at most one row per item; items without one are unreviewed.
    """
    rows = items.join(reviews, ["collection_id", "code"], "left").withColumn("review_status", F.coalesce("review_status", F.lit("unreviewed")))
    return rows.withColumn("export_eligible", F.coalesce("checked", F.lit(False)) & (F.col("review_status") == "approved") & (F.col("missing_roles") == "")).drop("checked")


def manual_crops(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crops, errors) of ``requests`` with box, an array of texts or numbers: four numbers with positive width and height, else the error."""
    numbers = F.transform("box", lambda v: v.try_cast("double"))
    rows = requests.withColumn("_b", numbers)
    four = F.coalesce(F.size("_b") == 4, F.lit(False))
    bad = F.exists("_b", lambda v: v.isNull() | F.isnan(v))
    flat = (F.get("_b", F.lit(2)) <= F.get("_b", F.lit(0))) | (F.get("_b", F.lit(3)) <= F.get("_b", F.lit(1)))
    error = F.when(~four, "box must contain four page-coordinate numbers").when(bad, "box values must be numeric").when(flat, "box must have positive width and height")
    rows = rows.withColumn("error", error)
    crops = rows.where("error is null").withColumn("box", F.col("_b")).withColumn("legend_crop_source", F.lit("manual")).withColumn("review_status", F.lit("requires_review")).drop("_b", "error")
    return crops, rows.where("error is not null").drop("_b")


def image_box(box: list[Column], crop: tuple[float, float, float, float], size: tuple[int, int]) -> list[Column]:
    """A page box (x0, y0, x1, y1) in the pixels of an image of ``size`` that shows ``crop``, rounded to 3 digits."""
    sx, sy = size[0] / max(crop[2] - crop[0], 1e-9), size[1] / max(crop[3] - crop[1], 1e-9)
    return [F.round(v * k + o, 3) for v, k, o in zip(box, (sx, sy, sx, sy), (-crop[0] * sx, -crop[1] * sy) * 2, strict=True)]


def page_box(box: list[Column], crop: tuple[float, float, float, float], size: tuple[int, int]) -> list[Column]:
    """The page box of a pixel box whose corners may come in any order; the inverse of :func:`image_box`."""
    sx, sy = size[0] / max(crop[2] - crop[0], 1e-9), size[1] / max(crop[3] - crop[1], 1e-9)
    x0, y0, x1, y1 = box
    ends = [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]
    return [F.round((v + k * o) / k, 3) for v, k, o in zip(ends, (sx, sy, sx, sy), (crop[0], crop[1]) * 2, strict=True)]


def diagnostic_failures(diagnosis: DataFrame) -> DataFrame:
    """The documents of ``diagnosis`` (of ``diagnose``) that another algorithm than the vector one gets: status and no features."""
    status = F.when(F.col("algorithm") == "diagnostic_only_v1", "diagnostic_only").otherwise("algorithm_routed_pending_profile")
    return diagnosis.where("algorithm <> 'vector_fill_style_polygon_v1'").select("collection_id", "algorithm", status.alias("classification_status"), F.lit(0).alias("features"))
