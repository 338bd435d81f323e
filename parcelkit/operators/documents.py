"""Operators on whole tables of drawings, features, spans and reviews; every group starts with collection_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles as s

# Words that mark the main drawing; type patterns by code; prefixes and classes of the vocabulary that have a group.
PAGE_WORDS = ["HLAVNÍ VÝKRES", "HLAVNI VYKRES", "ÚPLNÉ ZNĚNÍ", "UPLNE ZNENI", "Z12"]
TYPE_PATTERNS = {"STAV": ["stabil.*", "stav", "zastaven.*"], "NAVRH": ["navrh", "navrh", "zastaviteln.*", "zmena"], "REZERVA": ["rezerv.*"]}
# End of fixed values.
PAGE = (1200.0, 1700.0)
#: Numbers of a collection's features in a group, and pairs that a task holds at once, where labels are looked for.
PART, PIECE = 1 << 20, 1 << 20
AREA = "decimal(18,3)"


def fold(text: Column) -> Column:
    """Lower case without the marks of Czech and Slovak letters."""
    return F.translate(F.lower(text), "áäčďéěíĺľňóôöřŕšťúůüýž", "aacdeeillnooorrstuuuyz")


def target_label(folded: Column) -> Column:
    """The code that a folded text names in words: mixed housing before housing before recreation; null if none."""
    return F.when(folded.rlike(r"\bsmisene\s+(obytne|bydleni)\b"), "S").when(folded.rlike(r"\bbydleni\b|\bobyt(ne|ny)\b"), "B").when(folded.rlike(r"\brekreac(e|ni|ny)\b"), "R")


def rings(fragments: DataFrame) -> DataFrame:
    """Fragments as polygons: a triangle or rectangle at (x0, y0); every fifth one has a hole, inset by a quarter."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    box = lambda x, y, w, h: F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y + h), g.point(x, y))
    outer = F.when(F.col("shape") == "tri", F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y))).otherwise(box(x, y, w, h))
    hole = box(x + w / 4, y + h / 4, w / 2, h / 2)
    return fragments.withColumn("rings", F.when(F.col("drawing_index") % 5 == 0, F.array(outer, hole)).otherwise(F.array(outer)))


def geometry_profile(features: DataFrame) -> DataFrame:
    """``features`` (with rings) with closed, area, perimeter, bbox, points, holes, label and sharp; null rings give nulls."""
    outer = F.get("rings", F.lit(0))
    return (
        features.withColumn("closed", g.is_closed(outer)).withColumn("area", g.polygon_area(F.col("rings"))).withColumn("perimeter", g.ring_perimeter(outer))
        .withColumn("bbox", g.bbox(F.col("rings"))).withColumn("points", F.size(outer)).withColumn("holes", F.size("rings") - 1)
        .withColumn("label", g.label_point(outer)).withColumn("sharp", g.small_angles(outer))
    )


def select_page(pages: DataFrame) -> DataFrame:
    """The page of each collection with the best score: 10 for each word found, and a tenth of its hundreds of drawings; the later page wins ties."""
    text = F.upper(F.coalesce("page_text", F.lit("")))
    score = sum((text.contains(w).cast("int") * 10 for w in PAGE_WORDS), F.lit(0)) + F.least(F.floor(F.coalesce("drawing_count", F.lit(0)) / 100), F.lit(10))
    rank = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("score"), F.desc("page_index")))
    return pages.withColumn("score", score.cast("int")).withColumn("_n", rank).where("_n = 1").drop("_n")


def regions(features: DataFrame, legend: tuple[float, float, float, float] | None) -> DataFrame:
    """``features`` (x0, y0, w, h) with region: legend, title block, margin or map body, by centre and overlap with ``legend``."""
    cx, cy = (F.col("x0") + F.col("x0") + F.col("w")) / 2, (F.col("y0") + F.col("y0") + F.col("h")) / 2
    in_legend = F.lit(False)
    if legend:
        x0, y0, x1, y1 = legend
        w = F.greatest(F.least(F.col("x0") + F.col("w"), F.lit(x1)) - F.greatest(F.col("x0"), F.lit(x0)), F.lit(0.0))
        h = F.greatest(F.least(F.col("y0") + F.col("h"), F.lit(y1)) - F.greatest(F.col("y0"), F.lit(y0)), F.lit(0.0))
        in_legend = (cx.between(x0, x1) & cy.between(y0, y1)) | (w * h >= F.greatest(F.lit(4.0), F.col("w") * F.col("h") * 0.2))
    wide, high = PAGE
    return features.withColumn(
        "region",
        F.when(in_legend, "legend_candidate_region")
        .when((cy <= high * 0.075) | (cy >= high * 0.92) | ((cx >= wide * 0.9) & (cy <= high * 0.48)), "title_block_region")
        .when((cx >= wide * 0.88) & (cy >= high * 0.65), "legend_or_title_margin_region")
        .otherwise("map_body_region"),
    )


def tessellation_metrics(fragments: DataFrame, least: int = 10_000) -> DataFrame:
    """One row per collection: medians, shares of tiny and triangular fragments, of the 50 fullest half-point bands and of the commonest style, and whether tessellation is detected.

    Exact medians by collection; the shares need them and come from a second aggregation over the join.
    """
    f = fragments.withColumn("area", F.col("w") * F.col("h") / F.when(F.col("shape") == "tri", 2.0).otherwise(1.0))
    medians = f.groupBy("collection_id").agg(F.median("area").alias("median_area"), F.median("h").alias("median_height"), F.median("w").alias("median_width"))
    share = lambda c: F.count_if(c) / F.count("*")
    rows = f.join(medians, "collection_id").groupBy("collection_id").agg(
        F.count("*").alias("n"), F.first("median_area").alias("median_area"), F.first("median_height").alias("median_height"), F.first("median_width").alias("median_width"),
        share(F.col("h") <= F.greatest(F.lit(3.0), F.col("median_height") * 1.6)).alias("tiny_height_ratio"),
        share(F.col("area") <= F.greatest(F.lit(20.0), F.col("median_area") * 2.0)).alias("tiny_area_ratio"),
        share(F.col("shape") == "tri").alias("triangular_ratio"),
    )
    top = lambda key, k: (
        f.groupBy("collection_id", key.alias("_key")).count().withColumn("_n", F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("count"), "_key")))
        .where(F.col("_n") <= k).groupBy("collection_id").agg(F.sum("count").alias("hits"))
    )
    bands = top(F.rint((F.col("y0") + F.col("y0") + F.col("h")) / 2 * 2).cast("long"), 50).withColumnRenamed("hits", "band_hits")
    styles = top(F.coalesce("fill_hex", F.lit("none")), 1).withColumnRenamed("hits", "style_hits")
    rows = rows.join(bands, "collection_id").join(styles, "collection_id")
    found = (F.col("n") >= least) & (F.col("median_area") <= 30.0) & (F.col("tiny_height_ratio") >= 0.55) & (F.col("triangular_ratio") >= 0.65)
    return rows.withColumn("detected", found)


def fragment_roles(fragments: DataFrame, metrics: DataFrame) -> DataFrame:
    """``fragments`` (with region) with role, by ordered rules; ``metrics`` from tessellation_metrics, one row per collection."""
    area = F.col("w") * F.col("h") / F.when(F.col("shape") == "tri", 2.0).otherwise(1.0)
    f = fragments.withColumn("area", area).join(metrics.select("collection_id", "median_area", "median_height", "detected"), "collection_id")
    white = s.near_white(F.col("fill_hex"))
    return f.withColumn(
        "role",
        F.when(F.col("region") == "legend_candidate_region", "legend_symbol_fragment")
        .when(white & (F.col("w") * F.col("h") >= PAGE[0] * PAGE[1] * 0.5), "background_mask_fragment")
        .when(white, "text_mask_fragment")
        .when(F.col("fill_hex").isNull() & F.col("stroke_hex").isNotNull(), "linework_fragment")
        .when((F.col("shape") == "rect") & (F.col("area") <= F.greatest(F.lit(30.0), F.col("median_area") * 4.0)), "hatch_fragment")
        .when(F.col("detected") & ((F.col("shape") == "tri") | (F.col("h") <= F.greatest(F.lit(3.0), F.col("median_height") * 1.8)) | (F.least("w", "h") <= 1.5)), "tessellated_area_fragment")
        .when(F.col("region") == "map_body_region", "area_fill_candidate")
        .otherwise("unknown_fragment"),
    )


def style_definitions(drawings: DataFrame) -> DataFrame:
    """One row per style key of a collection: count, first drawing, up to 8 sample drawings (smallest indices)."""
    d = drawings.withColumn("dash_norm", s.dash(F.col("dashes"))["norm"])
    key = ["collection_id", "fill_hex", "stroke_hex", "stroke_width", "dash_norm"]
    near = d.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("drawing_index")))
    return near.groupBy(*key).agg(F.count("*").alias("n"), F.min("drawing_index").alias("first_drawing"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 8, F.col("drawing_index")))), lambda x: x.cast("string")), ",").alias("samples"))


def text_specs(spans: DataFrame) -> DataFrame:
    """Spans with text: trimmed and folded text, its code, its label's code, role and score. Blank texts go."""
    t = spans.withColumn("text", F.trim("raw_text")).where("text <> ''").withColumn("normalized", F.regexp_replace(fold(F.col("text")), r"\s+", " "))
    t = t.withColumn("code", s.target_code(F.col("text")))
    t = t.withColumn("label", target_label(F.col("normalized")))
    role = F.when(F.col("code").isNotNull(), "code").when(F.col("label").isNotNull(), "label").otherwise("text")
    return t.withColumn("role", role).withColumn("chars", F.length("text"))


def text_definitions(specs: DataFrame) -> DataFrame:
    """One row per normalized text and font of a collection: count and first span."""
    return specs.groupBy("collection_id", "normalized", "font_name").agg(F.count("*").alias("n"), F.min_by("text", "span_index").alias("sample"), F.min("span_index").alias("first_span"))


def expected_legend_rows(spans: DataFrame, legend: tuple[float, float, float, float]) -> DataFrame:
    """Every expected code for every collection, with its anchor: the first span inside the legend, else the first, else none."""
    specs = text_specs(spans)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(legend[0], legend[2]) & cy.between(legend[1], legend[3])
    anchors = specs.where("code is not null").groupBy("collection_id", "code").agg(F.min(F.struct((~inside).cast("int").alias("out"), "span_index")).alias("a"))
    codes = F.explode(F.array(*[F.lit(c) for c in s.TARGET_CODES])).alias("code")
    rows = spans.select("collection_id").distinct().select("collection_id", codes)
    confidence = F.when(F.col("a.out") == 0, 0.45).when(F.col("a.out") == 1, 0.28).otherwise(0.0)
    return rows.join(anchors.hint("shuffle_hash"), ["collection_id", "code"], "left").select("collection_id", "code", F.col("a.span_index").alias("anchor"), confidence.alias("confidence"))


def merge_groups(fragments: DataFrame) -> DataFrame:
    """Trusted fragments of the map body by style; groups of one fragment go."""
    trusted = F.col("role").isin("area_fill_candidate", "tessellated_area_fragment") & (F.col("region") == "map_body_region")
    groups = fragments.where(trusted).groupBy("collection_id", "fill_hex", "stroke_hex").agg(F.count("*").alias("n"), F.sum(F.col("area").cast(AREA)).alias("area"))
    return groups.where("n >= 2")


def _nearest(pad: float, reach: float):
    """Features of a cell beside the texts around it, in pieces of at most PIECE pairs."""

    def run(f: pa.Table, t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("span_index").combine_chunks()), kind="stable")
        tx, ty = (np.asarray(t.column(c).combine_chunks())[order] for c in ("tx", "ty"))
        x0, y0, x1, y1, cx, cy = (np.asarray(f.column(c).combine_chunks())[:, None] for c in ("x0", "y0", "fx1", "fy1", "fcx", "fcy"))
        best, score = np.zeros(len(f), np.int64), np.full(len(f), np.inf)
        step = max(1, PIECE // max(1, len(tx)))
        for i in range(0, len(f) if len(tx) else 0, step):
            k = slice(i, i + step)
            inside = (tx >= x0[k] - pad) & (tx <= x1[k] + pad) & (ty >= y0[k] - pad) & (ty <= y1[k] + pad)
            away = np.sqrt((tx - cx[k]) * (tx - cx[k]) + (ty - cy[k]) * (ty - cy[k]))
            away = np.where(inside, 0.0, np.where(away <= reach, away, np.inf))
            best[k] = away.argmin(axis=1)  # the first of equals, which has the smallest span_index
            score[k] = away[np.arange(len(away)), best[k]]
        found = np.flatnonzero(score < np.inf)
        out = f.select(["collection_id", "drawing_index"]).take(found)
        spans = t.column("span_index").combine_chunks().take(pa.array(order)).take(pa.array(best[found]))
        return pa.Table.from_arrays([*out.columns, spans, pa.array(score[found])], names=["collection_id", "drawing_index", "span_index", "score"])

    return run


def associate_labels(features: DataFrame, spans: DataFrame, pad: float = 18.0, reach: float = 35.0, cell: float = 64.0) -> DataFrame:
    """(collection_id, drawing_index, span_index, score): the nearest code text of each feature, none beyond ``reach``.

    A text whose centre lies in the box padded by ``pad`` scores 0, others their distance to the box's centre; the
    first span wins ties, so of texts at one place only the first counts. A feature goes to one grid cell, that of its centre, in a grid as wide as it
    reaches (``cell``, or that doubled); texts, the smaller side, go to the nine cells around them in each grid that has features. A group is one cell's
    features out of PART numbers of a collection, so no more than that; pairs stay in the task, best ones leave it. Time grows with features times places
    of texts in nine cells.
    """
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    f = features.select("collection_id", "drawing_index", "x0", "y0", x1.alias("fx1"), y1.alias("fy1"), ((F.col("x0") + x1) / 2).alias("fcx"), ((F.col("y0") + y1) / 2).alias("fcy")).where("fcx is not null and fcy is not null")
    far = F.greatest(F.lit(reach), (F.col("fx1") - F.col("x0")) / 2 + pad, (F.col("fy1") - F.col("y0")) / 2 + pad) * (1 + 1e-9)
    f = f.withColumn("wide", F.lit(cell) * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(far / cell)).cast("double"))))
    f = f.withColumn("part", F.floor(F.col("drawing_index") / PART)).withColumn("gx", F.floor(F.col("fcx") / F.col("wide"))).withColumn("gy", F.floor(F.col("fcy") / F.col("wide")))
    t = text_specs(spans).where("code is not null").select("collection_id", "span_index", ((F.col("x0") + F.col("x1")) / 2).alias("tx"), ((F.col("y0") + F.col("y1")) / 2).alias("ty")).where("tx is not null and ty is not null")
    t = t.groupBy("collection_id", "tx", "ty").agg(F.min("span_index").alias("span_index"))
    key = ["collection_id", "wide", "gx", "gy"]
    cells = f.select(*key, "part").distinct()
    grids = cells.select("collection_id", "wide").distinct()
    near = lambda at: F.explode(F.sequence(F.floor(F.col(at) / F.col("wide")) - 1, F.floor(F.col(at) / F.col("wide")) + 1))
    t = t.join(grids.hint("shuffle_hash"), "collection_id").withColumn("gx", near("tx")).withColumn("gy", near("ty"))
    t = t.join(cells.hint("shuffle_hash"), key).select(*[F.col(c).alias(c) for c in (*key, "part", "span_index", "tx", "ty")])  # columns of its own beside f's
    types = {x.name: x.dataType.simpleString() for x in [*features.schema, *spans.schema]}
    out = ", ".join(f"{c} {types[c]}" for c in ("collection_id", "drawing_index", "span_index")) + ", score double"
    by = [*key, "part"]
    return f.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(_nearest(pad, reach), out)


def infer_type(features: DataFrame) -> DataFrame:
    """``features`` with type and type_score from type_text: exact name 1, one pattern group .82, several .2, none .1, missing 0 (.9 for layer ZMEN)."""
    raw = F.nullif(F.col("type_text"), F.lit(""))
    folded = fold(raw)
    hits = {t: F.coalesce(F.greatest(*[folded.rlike(p).cast("int") for p in ps]) if len(ps) > 1 else folded.rlike(ps[0]).cast("int"), F.lit(0)) for t, ps in TYPE_PATTERNS.items()}
    n = sum(hits.values(), F.lit(0))
    exact = F.upper(raw).isin(*TYPE_PATTERNS)
    only = F.when(hits["STAV"] == 1, "STAV").when(hits["NAVRH"] == 1, "NAVRH").otherwise("REZERVA")
    zmen = raw.isNull() & (F.col("layer") == "ZMEN")
    kind = F.when(zmen, "NAVRH").when(raw.isNull(), "UNMAPPED").when(exact, F.upper(raw)).when(n == 1, only).otherwise("UNMAPPED")
    score = F.when(zmen, 0.9).when(raw.isNull(), 0.0).when(exact, 1.0).when(n == 1, 0.82).when(n > 1, 0.2).otherwise(0.1)
    return features.withColumn("type", kind).withColumn("type_score", score)


def longest_prefix(features: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``features`` with the group of the longest prefix of LAYER.CLASS; ``prefixes``: (prefix, label). Each distinct key is looked up by all of its beginnings, so the join is on equality."""
    keys = features.select("layer", "class").distinct().withColumn("key", F.concat_ws(".", F.coalesce("layer", F.lit("UNCLASSIFIED")), F.coalesce("class", F.lit("UNMAPPED"))))
    begins = keys.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))))
    found = begins.join(prefixes.hint("shuffle_hash"), "prefix", "left").groupBy("layer", "class", "key").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.length("prefix"))).alias("group_label"))
    same = features["layer"].eqNullSafe(found["layer"]) & features["class"].eqNullSafe(found["class"])
    return features.join(found.hint("shuffle_hash"), same, "left").drop(found["layer"], found["class"])


def latest_state(events: DataFrame) -> DataFrame:
    """The last action of every target: by time, then by event id."""
    last = F.max_by(F.struct("event_id", "action", "area_after"), F.struct("ts", "event_id"))
    return events.groupBy("collection_id", "target_id").agg(F.count("*").alias("events"), last.alias("m")).select("collection_id", "target_id", "events", "m.event_id", "m.action", "m.area_after")


def validate_edits(events: DataFrame, most: float = 25.0) -> DataFrame:
    """Edits with their change of area in percent (100 when there was none before) and status: invalid, needs a note, or saved."""
    change = F.when(F.col("area_before") == 0, 100.0).otherwise(F.abs(F.col("area_after") - F.col("area_before")) / F.col("area_before") * 100.0)
    rows = events.where("action = 'edit'").withColumn("change", change)
    status = F.when(F.col("area_after").isNull() | (F.col("area_after") <= 0), "invalid").when((F.col("change") > most) & F.coalesce(F.trim("note_json") == "", F.lit(True)), "needs_note").otherwise("saved")
    return rows.withColumn("status", status)
