"""Operators on evidence: page diagnosis, classification, remapping, artifacts and reviews of whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles as s
from . import documents as d

TYPE_CODES = {"STAV": 1, "NAVRH": 2, "REZERVA": 3}


def source_type(pages: DataFrame) -> DataFrame:
    """``pages`` with source_type, confidence and scanned, by their counts of drawings, images and texts; null counts are 0."""
    vector, image, text = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("drawing_count", "image_count", "text_span_count"))
    kind = F.when(vector & image, "mixed_pdf").when(vector, "vector_pdf").when(image, "raster_pdf").otherwise("unsupported_pdf")
    sure = F.when(vector & image, 0.88).when(vector, 0.92).when(image, 0.82).otherwise(0.35)
    return pages.withColumn("source_type", kind).withColumn("confidence", sure).withColumn("scanned", image & ~vector & ~text)


def full_page(wide: float, high: float, near: float = 1.5) -> Column:
    """Whether the box (x0, y0, w, h) reaches all four sides of the page."""
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return (F.abs(F.col("x0")) <= near) & (F.abs(F.col("y0")) <= near) & (F.abs(x1 - wide) <= near) & (F.abs(y1 - high) <= near)


def diagnose(drawings: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per collection of ``pages``: counts of fills, strokes, backgrounds, images and labels, only_background and the algorithm.

    Collections without drawings or spans count 0. A label candidate is a word that starts with Z, P or K.
    """
    white = F.col("fill_hex").isin("#ffffff", "#fefefe", "#fdfdfd")
    drawn = drawings.groupBy("collection_id").agg(
        F.count_distinct("fill_hex").alias("fills"), F.count_distinct(F.when(~white, F.col("fill_hex"))).alias("coloured"), F.count_distinct("stroke_hex").alias("strokes"),
        F.count_if(white & full_page(*d.PAGE)).alias("backgrounds"),
    )
    words = spans.select("collection_id", F.explode(F.split("raw_text", r"\s+")).alias("word")).groupBy("collection_id").agg(F.count_if(F.upper(F.substring("word", 1, 1)).isin("Z", "P", "K")).alias("labels"))
    rows = pages.groupBy("collection_id").agg(F.sum("image_count").alias("images")).join(drawn.hint("shuffle_hash"), "collection_id", "left").join(words.hint("shuffle_hash"), "collection_id", "left").na.fill(0)
    rows = rows.withColumn("only_background", (F.col("backgrounds") >= 1) & (F.col("coloured") == 0) & (F.col("fills") <= 1))
    choice = (
        F.when(F.col("only_background"), "diagnostic_only_v1").when(F.col("coloured") > 0, "vector_fill_style_polygon_v1").when(F.col("images") > 0, "raster_style_segmentation_v1")
        .when((F.col("labels") > 0) | (F.col("strokes") > 0), "vector_text_boundary_topology_v1").otherwise("diagnostic_only_v1")
    )
    return rows.withColumn("algorithm", choice)


def normalized(features: DataFrame) -> DataFrame:
    """``features`` with layer_class and class_type; missing names are UNCLASSIFIED and UNMAPPED, an unknown type has code 0."""
    layer, cls = F.coalesce("layer", F.lit("UNCLASSIFIED")), F.coalesce("class", F.lit("UNMAPPED"))
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t, c in TYPE_CODES.items() for x in (t, str(c))]), F.upper(F.coalesce("type_text", F.lit("")))), F.lit("0"))
    return features.withColumn("layer_class", F.concat_ws(".", layer, cls)).withColumn("class_type", F.concat_ws(".", cls, code))


def shape_metrics(profile: DataFrame) -> DataFrame:
    """``profile`` (of geometry_profile) with aspect, compactness, complexity, spike and the flags needle, sliver and corridor."""
    wide, high = F.greatest(F.col("bbox.x1") - F.col("bbox.x0"), F.lit(0.0)), F.greatest(F.col("bbox.y1") - F.col("bbox.y0"), F.lit(0.0))
    thin, area, one = F.least(wide, high), F.col("area"), F.lit(1.0)
    aspect = F.when((wide > 0) & (high > 0), F.greatest(wide, high) / F.greatest(thin, F.lit(1e-9))).otherwise(0.0)
    compact = F.when((F.col("perimeter") > 0) & (area > 0), 4 * math.pi * area / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0)
    rows = profile.withColumn("thin", thin).withColumn("aspect", aspect).withColumn("compactness", compact)
    rows = rows.withColumn("complexity", F.greatest(F.col("points") - 1, F.lit(0)) / F.sqrt(F.greatest(area, one)))
    spike = 0.35 * F.least(F.col("aspect") / 30.0, one) + 0.30 * F.least(F.col("sharp") / 6.0, one) + 0.20 * (1.0 - F.least(F.col("compactness") / 0.18, one)) + 0.15 * F.least(F.col("complexity") / 18.0, one)
    return (
        rows.withColumn("spike", F.least(spike, one)).withColumn("needle", (F.col("spike") >= 0.74) & (F.col("aspect") >= 20))
        .withColumn("sliver", (F.col("compactness") <= 0.035) & (F.col("aspect") >= 12)).withColumn("corridor", (F.col("thin") > 0) & (F.col("thin") <= 2.5) & (area >= 20))
    )


def hole_classes(features: DataFrame) -> DataFrame:
    """One row per hole of ``features`` (with rings): hole_index, hole_area, hole_ratio, vertices, hole_class and removable."""
    rows = features.withColumn("outer_area", g.ring_area_abs(F.get("rings", F.lit(0)))).select("*", F.posexplode("rings").alias("hole_index", "hole")).where("hole_index > 0")
    b = g.bbox(F.array("hole"))
    rows = rows.withColumn("hole_area", g.ring_area_abs(F.col("hole"))).withColumn("hole_ratio", F.col("hole_area") / F.nullif(F.col("outer_area"), F.lit(0.0))).withColumn("vertices", F.greatest(F.size("hole") - 1, F.lit(0)))
    rows = rows.withColumn("side", F.least(b["x1"] - b["x0"], b["y1"] - b["y0"])).withColumn("rectangularity", F.col("hole_area") / F.greatest(g.bbox_area(b), F.lit(1e-9)))
    ratio, rect = F.col("hole_ratio"), F.col("rectangularity")
    kind = (
        F.when((rect >= 0.82) & (ratio <= 0.018), "label_mask_rectangle").when((F.col("vertices") <= 3) | (F.col("hole_area") <= 35.0) | (F.col("side") <= 2.5), "hatch_grid_artifact")
        .when((rect >= 0.72) & (ratio <= 0.03), "white_background_artifact").when((ratio >= 0.025) & (rect < 0.55), "real_planning_void").otherwise("unknown_review_required")
    )
    return rows.withColumn("hole_class", kind).withColumn("removable", kind.isin("label_mask_rectangle", "hatch_grid_artifact", "white_background_artifact"))


def classify_evidence(rows: DataFrame, sources: dict[str, float]) -> DataFrame:
    """``rows`` with proposed_class, proposed_code, confidence, rule and review from the codes and labels of ``sources`` (column: score, in order of preference).

    No evidence gives UNMAPPED (.12 with a colour, else 0); several codes or classes a conflict (.24); otherwise the first best source wins,
    less .18 where dash_norm is not solid. Needs fill_hex, stroke_hex and dash_norm; ``*_text`` sources count as text.
    """
    classes = F.create_map(*[F.lit(x) for pair in s.TARGET_CODES.items() for x in pair])
    found = []
    for order, (column, score) in enumerate(sources.items()):
        folded = F.regexp_replace(d.fold(F.trim(F.col(column))), r"\s+", " ")
        for k, (code, value) in enumerate(((s.target_code(F.col(column)), score), (d.target_label(folded), score - 0.04))):
            hit = F.struct(F.lit(value).alias("score"), F.lit(-2 * order - k).alias("order"), code.alias("code"), F.try_element_at(classes, code).alias("cls"), F.lit(column).alias("name"))
            found.append(F.when(code.isNotNull(), hit))
    rows = rows.withColumn("_e", F.filter(F.array(*found), lambda x: x.isNotNull()))
    best, dashed = F.array_max("_e"), F.coalesce(F.col("dash_norm") != "solid", F.lit(False))
    none = F.size("_e") == 0
    clash = (F.size(F.array_distinct(F.transform("_e", lambda x: x["code"]))) > 1) | (F.size(F.array_distinct(F.transform("_e", lambda x: x["cls"]))) > 1)
    texts = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in sources if c.endswith("_text")]).isNotNull()
    weak = ~best["name"].endswith("_text") & ~texts
    coloured = F.coalesce("fill_hex", "stroke_hex").isNotNull()
    return (
        rows.withColumn("proposed_class", F.when(none | clash, "UNMAPPED").otherwise(best["cls"])).withColumn("proposed_code", F.when(~none & ~clash, best["code"]))
        .withColumn("confidence", F.when(none, F.when(coloured, 0.12).otherwise(0.0)).when(clash, 0.24).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.98), best["score"] - F.when(dashed, 0.18).otherwise(0.0)))))
        .withColumn("rule", F.when(none, "unknown_requires_review").when(clash, "conflicting_target_evidence").otherwise(best["name"])).withColumn("review", none | clash | dashed | weak).drop("_e")
    )


def remap(features: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per distinct (layer, class, type_text, ref): proposed_class, type, display_label, score and review.

    ``classes`` (layer_class, label) is the vocabulary. A listed class keeps its name, a custom one needs ref, others are UNMAPPED.
    """
    rows = d.infer_type(features.select("layer", "class", "type_text", "ref").distinct())
    rows = rows.withColumn("layer_class", F.concat_ws(".", F.coalesce("layer", F.lit("UNCLASSIFIED")), F.coalesce("class", F.lit("UNMAPPED"))))
    rows = rows.join(classes.hint("shuffle_hash"), "layer_class", "left")
    custom, listed, ref = F.col("layer_class").startswith("CUST."), F.col("label").isNotNull(), F.nullif(F.col("ref"), F.lit(""))
    unsure = F.col("type_score") < 0.8
    return (
        rows.withColumn("proposed_class", F.when(listed | (custom & ref.isNotNull()), F.coalesce("class", F.lit("UNMAPPED"))).otherwise("UNMAPPED"))
        .withColumn("display_label", F.when(listed & ref.isNotNull(), F.concat("label", F.lit(" ("), ref, F.lit(")"))).when(listed, F.col("label")).when(custom & ref.isNotNull(), F.concat("layer_class", F.lit(" - "), ref)))
        .withColumn("score", F.when(listed, F.least(F.lit(0.96), 0.75 + F.col("type_score") / 4)).when(custom & ref.isNotNull(), 0.78).otherwise(F.col("type_score") / 2))
        .withColumn("review", F.when(listed, unsure | (custom & ref.isNull())).when(custom & ref.isNotNull(), unsure).otherwise(True)).drop("label")
    )


def evidence_index(drawings: DataFrame) -> DataFrame:
    """``drawings`` with evidence: the role by colours and sizes; the later of several matching rules holds."""
    w, h, width = F.col("w"), F.col("h"), F.coalesce("stroke_width", F.lit(0.0))
    aspect = F.when((w > 0) & (h > 0), F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6))).otherwise(0.0)
    white = lambda c: s.near_white(F.col(c), 235, 24)
    black = s.near_black(F.col("stroke_hex"), 45, 28) | s.near_black(F.col("fill_hex"), 45, 28)
    role = (
        F.when(black & (w <= 22) & (h <= 22) & (w * h <= 220), "dotted_boundary_dot").when(black & ((width >= 1.8) | (F.least(w, h) <= 3.0) | (aspect >= 8.0)), "thick_boundary_line")
        .when(white("stroke_hex") & (width <= 1.2) & (aspect >= 4.0), "hatch_line").when(white("fill_hex") & (w * h <= 5000), "label_mask").when(s.red_fill(F.col("fill_hex")), "fill_region").otherwise("unknown")
    )
    return drawings.withColumn("evidence", role)


def region_of_interest(features: DataFrame, pad: float = 80.0) -> DataFrame:
    """One row per collection: the box around all its ``features``, padded."""
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return features.groupBy("collection_id").agg((F.min("x0") - pad).alias("rx0"), (F.min("y0") - pad).alias("ry0"), (F.max(x1) + pad).alias("rx1"), (F.max(y1) + pad).alias("ry1"))


def legend_rows(spans: DataFrame, legend: tuple[float, float, float, float]) -> DataFrame:
    """One row per code of a collection that stands inside ``legend``: row_y (median of its centres), top and bottom; ordered by row_y, then code."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(legend[0], legend[2]) & cy.between(legend[1], legend[3])
    rows = d.text_specs(spans).where("code is not null").where(inside).withColumn("cy", cy).groupBy("collection_id", "code").agg(F.median("cy").alias("row_y"))
    after = F.lead("row_y").over(Window.partitionBy("collection_id").orderBy("row_y", "code"))
    return rows.withColumn("top", F.col("row_y") - 15.0).withColumn("bottom", F.least(F.coalesce(after, F.col("row_y") + 42.0) - 6.0, F.col("row_y") + 45.0))


def latest(events: DataFrame, action: str) -> DataFrame:
    """The last event of ``action`` for each target with how many there were; blank notes do not count."""
    noted = events.where((F.col("action") == action) & (F.coalesce(F.trim("note_json"), F.lit("")) != ""))
    last = F.max_by(F.struct("event_id", "note_json"), F.struct("ts", "event_id"))
    return noted.groupBy("collection_id", "target_id").agg(F.count("*").alias("n"), last.alias("m")).select("collection_id", "target_id", "n", "m.event_id", "m.note_json")


def constraint_report(features: DataFrame) -> DataFrame:
    """One row per collection with the number of rows that break each rule; nulls break none but those that ask for a value."""
    kind = F.upper("type_text")
    return features.groupBy("collection_id").agg(
        F.count_if((F.col("layer") == "ZMEN") & (F.coalesce(kind, F.lit("NAVRH")) != "NAVRH")).alias("zmen_not_navrh"),
        F.count_if((F.col("layer") == "CUST") & F.col("text_id").isNull()).alias("custom_without_ref"),
        F.count_if((F.col("layer") == "ZMEN") & F.col("style_hex").isNotNull()).alias("zmen_filled"),
        F.count_if(~kind.isin(*TYPE_CODES)).alias("unknown_type"), F.count_if(F.col("class").isNull()).alias("class_missing"),
        F.count_if(F.coalesce(F.col("area"), F.lit(0.0)) <= 0).alias("no_area"),
    )


def facets(features: DataFrame, layer: str | None = None, cls: str | None = None) -> DataFrame:
    """(facet, value, n): layers, classes under ``layer``, types under both; a choice that occurs nowhere falls back to all."""
    names = features.select(F.coalesce("layer", F.lit("UNCLASSIFIED")).alias("layer"), F.coalesce("class", F.lit("UNMAPPED")).alias("class"), F.coalesce("type_text", F.lit("UNMAPPED")).alias("type"))
    counted = names.groupBy("layer", "class", "type").agg(F.count("*").alias("n"))
    has = lambda df, c, v: F.lit(True) if v is None or df.where(F.col(c) == v).isEmpty() else F.col(c) == v
    under = counted.where(has(counted, "layer", layer))
    both = under.where(has(under, "class", cls))
    part = lambda df, c: df.groupBy(F.lit(c).alias("facet"), F.col(c).alias("value")).agg(F.sum("n").alias("n"))
    return part(counted, "layer").unionByName(part(under, "class")).unionByName(part(both, "type"))
