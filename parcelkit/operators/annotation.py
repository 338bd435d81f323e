"""Review state of features: flags, proposals and colours; artifact counts; the methods that a document's extraction used; styles of legend symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles as s
from . import evidence as e
from . import paths as p

# Colours of classes, the colour of unmapped ones and of strokes; methods of an extraction, in their order.
CLASS_COLORS = {"BI": "#d9483f", "BV": "#ce6f58", "BH": "#c75c91", "BU": "#d85b52", "BX.c": "#b95672", "BX.p": "#b66b8a", "BX.r": "#a26192", "RI": "#86b37f", "RX": "#74a36d", "SV": "#d98989", "SC": "#cc7f9f", "SX": "#bb8fce"}
UNMAPPED_COLOR, STROKE_COLOR = "#9ca3af", "#222222"
METHODS = ["fill_style_polygonization", "hatch_pattern_segmentation", "dotted_boundary_segmentation", "thick_line_boundary_segmentation", "text_anchor_region_assignment", "legend_style_mapping", "raster_assisted_segmentation", "manual_split_required"]
# End of fixed values.
ROLES = ("stav_stabil", "navrh")
#: Classes of holes and the columns that count them.
HOLE_COUNTS = [("label_mask_rectangle", "label_masks"), ("hatch_grid_artifact", "hatch_grids"), ("white_background_artifact", "white_backgrounds"), ("real_planning_void", "real_voids"), ("unknown_review_required", "unknown_holes")]


def artifact_flags() -> Column:
    """The sorted flags of a feature from style_hex, spike, needle, sliver, corridor, void_review, hole_review and islands; nulls raise none."""
    on = lambda c: F.coalesce(c, F.lit(False))
    found = {
        "white_fill_candidate": s.near_white(F.col("style_hex")),
        "needle_spike_candidate": on(F.col("needle")),
        "sliver_component_candidate": on(F.col("sliver")),
        "void_artifact_candidate": on(F.col("void_review") > 0),
        "unknown_hole_review_required": on(F.col("hole_review") > 0),
        "thin_corridor_candidate": on(F.col("corridor")),
        "tiny_island_candidate": on(F.col("islands") > 0),
    }
    any_ = on(F.col("spike") >= 0.74)
    for name in list(found)[1:]:
        any_ = any_ | found[name]
    flags = [F.when(c, name) for name, c in found.items()] + [F.when(any_, "artifact_requires_review")]
    return F.array_sort(F.filter(F.array(*flags), lambda x: x.isNotNull()))


def display_color(style: Column, legend_fill: Column, cls: Column) -> Column:
    """(fill, source): the source's fill unless near white, else the legend's, else the class's, else grey."""
    table = F.create_map(*[F.lit(x) for pair in CLASS_COLORS.items() for x in pair])
    own = (F.coalesce(style, F.lit("")) != "") & ~s.near_white(style)
    legend, mapped = F.coalesce(legend_fill, F.lit("")) != "", F.coalesce(cls, F.lit("UNMAPPED")) != "UNMAPPED"
    fill = F.when(own, style).when(legend, legend_fill).when(mapped, F.coalesce(F.try_element_at(table, cls), F.lit(UNMAPPED_COLOR))).otherwise(UNMAPPED_COLOR)
    source = F.when(own, "source_style").when(legend, "legend_symbol").when(mapped, "proposed_class").otherwise("fallback_unmapped")
    return F.struct(fill.alias("fill"), source.alias("source"))


def annotate(features: DataFrame, items: DataFrame, definitions: DataFrame) -> DataFrame:
    """``features`` with flags, proposal, colours, status, export_blocking_reason, trust_state and artifact_count; nothing is ever export_eligible here.

    ``items`` (collection_id, code, missing: expected symbols not found) has one row per code; of ``definitions`` (collection_id, code, nth, def_fill, def_stroke)
    the smallest nth counts. Legends are small beside features and are broadcast, so that features are not dealt out by code. Features need those columns of :func:`artifact_flags`, stroke_hex, type_text and target_code (null or empty: no proposal).
    """
    first = definitions.groupBy("collection_id", "code").agg(F.min(F.struct("nth", "def_fill", "def_stroke")).alias("d"))
    known = items.join(first, ["collection_id", "code"], "left").select("collection_id", F.col("code").alias("target_code"), F.lit(True).alias("matched_item"), "missing", F.col("d.def_fill").alias("legend_fill"), F.col("d.def_stroke").alias("legend_stroke"))
    rows = features.withColumn("target_code", F.nullif(F.col("target_code"), F.lit(""))).join(F.broadcast(known), ["collection_id", "target_code"], "left").withColumn("flags", artifact_flags())
    has, flagged = F.col("target_code").isNotNull(), F.size("flags") > 0
    rows = rows.withColumn("proposed_layer", F.when(has, "RZVP").otherwise("UNMAPPED")).withColumn("proposed_class", F.coalesce("target_code", F.lit("UNMAPPED")))
    rows = rows.withColumn("proposed_type", F.when(has, F.coalesce("type_text", F.lit("UNMAPPED"))).otherwise("UNMAPPED")).withColumn("display", display_color(F.col("style_hex"), F.col("legend_fill"), F.col("proposed_class")))
    one = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    reason = (
        F.when(flagged, "Blocked: geometry artifact candidate requires human review before export")
        .when(F.coalesce(F.col("missing"), F.lit(0)) > 0, F.concat(F.lit("Blocked: matched legend item "), "target_code", F.lit(" is missing STAV/NAVRH symbol confirmation")))
        .when(has, F.concat(F.lit("Blocked: proposed mapping "), "target_code", F.lit(" needs explicit human approval")))
        .otherwise("Blocked: no legend match or proposal evidence available")
    )
    return (
        rows.withColumn("display_fill", F.col("display.fill")).withColumn("display_source", F.col("display.source")).withColumn("display_stroke", F.coalesce(F.nullif("legend_stroke", F.lit("")), F.nullif("stroke_hex", F.lit("")), F.lit(STROKE_COLOR)))
        .withColumn("status", F.when(flagged, "artifact_requires_review").otherwise("requires_review")).withColumn("export_blocking_reason", reason).withColumn("export_eligible", F.lit(False))
        .withColumn("trust_state", F.when(flagged, "review_only").otherwise("mapping_review_required"))
        .withColumn("artifact_count", sum((one(c) for c in ("needle", "sliver", "corridor", "void_review", "islands", "hole_review")), F.lit(0))).drop("display")
    )


def artifact_diagnostics(raw: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row per collection: white fragments and their area in ``raw`` (style_hex, area), and what :func:`annotate` says of the primary features."""
    white = s.near_white(F.col("style_hex"))
    fragments = raw.groupBy("collection_id").agg(F.count("*").alias("fragments"), F.count_if(white).alias("white_fragments"), F.coalesce(F.sum(F.when(white, F.col("area").cast("decimal(18,3)"))), F.lit(0)).cast("decimal(18,3)").alias("white_area"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    primary = annotated.groupBy("collection_id").agg(
        count(white).alias("trusted_white"), F.round(F.max("spike"), 4).alias("max_spike"), count(F.col("spike") >= 0.55).alias("spikes"), count(F.col("needle")).alias("needles"),
        count(F.col("sliver")).alias("slivers"), count(F.col("corridor")).alias("corridors"), count(F.array_contains("flags", "needle_spike_candidate")).alias("spike_reviews"),
        count(F.array_contains("flags", "artifact_requires_review")).alias("artifact_reviews"), count(~F.col("export_eligible")).alias("export_blocked"),
    )
    return fragments.join(primary, "collection_id", "left").na.fill(0)


def method_counts(raw: DataFrame, *more: Column) -> DataFrame:
    """One row per collection of ``raw`` fragments (style_hex, stroke_hex, stroke_width, w, h, area): objects, and candidates of hatches, dots and thick boundaries; ``more`` is counted along."""
    white = s.near_white(F.col("stroke_hex")) | s.near_white(F.col("style_hex"))
    black = s.near_black(F.col("stroke_hex")) | s.near_black(F.col("style_hex"))
    thin, long = F.least("w", "h"), F.greatest("w", "h")
    return raw.groupBy("collection_id").agg(
        F.count("*").alias("objects"), F.count_if(white & ((F.col("area") <= 250) | (thin <= 4))).alias("hatches"), F.count_if(black & (F.col("area") <= 180) & (long <= 20)).alias("dots"),
        F.count_if(black & ((F.coalesce("stroke_width", F.lit(0.0)) >= 1.8) | (thin <= 3)) & (F.col("area") <= 1200)).alias("thick"), *more,
    )


def extraction_profile(counts: DataFrame) -> DataFrame:
    """``counts`` of :func:`method_counts` with hatch_holes, primary, anchors, legends, blocked (nulls: 0), and: manual_split, export_status, confidence and methods.

    methods: a struct (method, status, used, evidence) for each of METHODS, in order.
    """
    rows = counts.na.fill(0, ["hatch_holes", "primary", "anchors", "legends", "blocked"])
    hatches = F.col("hatches") + F.col("hatch_holes")
    manual = (hatches > 0) | (F.col("dots") > 0) | (F.col("thick") > 0)
    stopped = manual | (F.col("blocked") > 0)
    no = F.lit(False)
    told = [
        (F.when(F.col("primary") > 0, "used").otherwise("failed"), F.lit(True), F.col("primary")),
        (F.when(hatches > 0, "manual_required").otherwise("not_attempted"), no, hatches),
        (F.when(F.col("dots") > 0, "manual_required").otherwise("not_attempted"), no, F.col("dots")),
        (F.when(F.col("thick") > 0, "review_required").otherwise("not_attempted"), no, F.col("thick")),
        (F.when(F.col("anchors") > 0, "used").otherwise("not_attempted"), F.col("anchors") > 0, F.col("anchors")),
        (F.when(F.col("legends") > 0, "used").otherwise("review_required"), F.col("legends") > 0, F.col("legends")),
        (F.lit("attempted"), no, F.lit(0)),
        (F.when(stopped, "manual_required").otherwise("not_attempted"), no, F.col("blocked")),
    ]
    methods = F.array(*[F.struct(F.lit(m).alias("method"), a.alias("status"), u.alias("used"), n.cast("long").alias("evidence")) for m, (a, u, n) in zip(METHODS, told, strict=True)])
    return rows.withColumn("methods", methods).withColumn("manual_split", manual).withColumn("export_status", F.when(stopped, "blocked").otherwise("review_required")).withColumn("confidence", F.when(stopped, "review_required").otherwise("candidate"))


def attach_profile(annotated: DataFrame, profiles: DataFrame) -> DataFrame:
    """``annotated`` with methods_used and manual_split_required: features with a text near by or a proposal, where the document needs manual splits; they are blocked for that reason."""
    used = F.transform(F.filter("methods", lambda m: m["used"]), lambda m: m["method"])
    rows = annotated.join(F.broadcast(profiles.select("collection_id", used.alias("methods_used"), F.col("manual_split").alias("_manual"))), "collection_id", "left")
    text = F.nullif(F.col("text_nearby"), F.lit("")).isNotNull() if "text_nearby" in annotated.columns else F.lit(False)
    rows = rows.withColumn("manual_split_required", F.coalesce("_manual", F.lit(False)) & (text | (F.col("proposed_class") != "UNMAPPED"))).drop("_manual")
    return rows.withColumn("export_blocking_reason", F.when(F.col("manual_split_required"), "Blocked: manual split required for hatch/dotted-boundary semantic separation").otherwise(F.col("export_blocking_reason")))


def dominant_styles(symbols: DataFrame, features: DataFrame, cell: float = 64.0, order: tuple[str, ...] = ("drawing_index",)) -> DataFrame:
    """``symbols`` (of legend_symbols) with near (features whose box overlaps the swatch, 10 wider and 8 higher on each side) and their commonest fill (not white or black), stroke (not white) and width, the first one on ties.

    Features (x0, y0, w, h, fill_hex, stroke_hex, stroke_width) come by ``order``: whole numbers, or several columns, the first one whole numbers. Swatches at one place count once. Features inside the extent of all
    swatches meet them in grid cells, each pair in the one where its overlap begins, so pairs need not be told apart: they are counted by style where they arise.
    """
    box, style = ["collection_id", "sx0", "sy0", "sx1", "sy1"], ["fill", "stroke", "width"]
    at = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    swatch = symbols.select(*box, (F.col("sx0") - 10).alias("a0"), (F.col("sy0") - 8).alias("b0"), (F.col("sx1") + 10).alias("a1"), (F.col("sy1") + 8).alias("b1")).distinct()
    extent = swatch.agg(F.min("a0").alias("ex0"), F.min("b0").alias("ey0"), F.max("a1").alias("ex1"), F.max("b1").alias("ey1")).where("ex0 is not null")
    swatch = swatch.withColumn("gx", at(F.col("a0"), F.col("a1"))).withColumn("gy", at(F.col("b0"), F.col("b1")))
    x1, y1 = F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    fill = F.when(~F.col("fill_hex").isin("", "#ffffff", "#fff", "#000000"), F.col("fill_hex")).alias("fill")
    stroke = F.when(~F.col("stroke_hex").isin("", "#ffffff"), F.col("stroke_hex")).alias("stroke")
    f = features.select("collection_id", *order, "x0", "y0", x1.alias("x1"), y1.alias("y1"), fill, stroke, F.col("stroke_width").alias("width"))
    over = lambda *c: (F.least("x1", c[2]) > F.greatest("x0", c[0])) & (F.least("y1", c[3]) > F.greatest("y0", c[1]))
    ends = ("ex0", "ey0", "ex1", "ey1")
    f = f.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").join(F.broadcast(extent), over(*ends))
    f = p.numbered(f, "nth", *order) if len(order) > 1 else f.withColumn("nth", F.col(order[0]))
    f = f.withColumn("gx", at(F.greatest("x0", "ex0"), F.least("x1", "ex1"))).withColumn("gy", at(F.greatest("y0", "ey0"), F.least("y1", "ey1"))).drop(*ends, *order)
    begins = (F.col("gx") == F.floor(F.greatest("x0", "a0") / cell)) & (F.col("gy") == F.floor(F.greatest("y0", "b0") / cell))
    pairs = f.join(swatch.hint("shuffle_hash"), ["collection_id", "gx", "gy"]).where(over("a0", "b0", "a1", "b1") & begins)
    styles = pairs.groupBy(*box, *style).agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("near", F.lit("")), *((k, F.col(k).cast("string")) for k in style))]))
    told = styles.select(*box, "n", "first", values.alias("v")).select(*box, "n", "first", "v.*").where("value is not null")
    counted = told.groupBy(*box, "kind", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = lambda k: F.max_by("value", F.when(F.col("kind") == k, F.struct("n", -F.col("first"), "value"))).alias(f"symbol_{k}")
    found = counted.groupBy(*box).agg(F.max(F.when(F.col("kind") == "near", F.col("n"))).alias("near"), *[best(k) for k in style])
    rows = symbols.join(found.hint("shuffle_hash"), box, "left").select(*symbols.columns, "near", *[f"symbol_{k}" for k in style])
    return rows.withColumn("near", F.coalesce("near", F.lit(0))).withColumn("symbol_width", F.col("symbol_width").cast("double"))


def legend_definitions(styled: DataFrame) -> DataFrame:
    """One definition per symbol of ``styled`` (of dominant_styles) with an expected role: layer, class, type, colours and confidence, unreviewed."""
    stav = F.col("role") == "stav_stabil"
    return styled.where(F.col("role").isin(*ROLES)).select(
        "collection_id", "code", "role", F.when(stav, 1).otherwise(2).alias("nth"), F.lit("RZVP").alias("layer"), F.col("code").alias("class"), F.when(stav, "STAV").otherwise("NAVRH").alias("type"),
        F.col("symbol_fill").alias("def_fill"), F.col("symbol_stroke").alias("def_stroke"), F.when(F.col("symbol_fill").isNotNull(), 0.72).otherwise(0.45).alias("confidence"), F.lit("unreviewed").alias("review_status"),
    )


def missing_symbols(items: DataFrame) -> DataFrame:
    """A row without style for each role that an item of ``items`` (of legend_items) lacks, with the task that asks for it."""
    rows = items.where("missing_roles != ''").select("collection_id", "code", F.explode(F.split("missing_roles", ",")).alias("role"))
    rows = rows.withColumn("symbol_order", F.when(F.col("role") == "stav_stabil", 1).otherwise(2)).withColumn("symbol_status", F.lit("missing_expected_symbol_requires_review"))
    return rows.withColumn("task_id", F.concat_ws("-", F.lit("missing-symbol"), "code", "role")).withColumn("reason", F.concat(F.col("code"), F.lit(" has no "), F.col("role"), F.lit(" symbol in the legend")))


def legend_totals(items: DataFrame) -> DataFrame:
    """One row per collection: legend items, those with both symbols, missing symbols and extras."""
    missing = F.when(F.col("missing_roles") == "", 0).otherwise(F.size(F.split("missing_roles", ",")))
    return items.groupBy("collection_id").agg(F.count("*").alias("items"), F.count_if(F.col("missing_roles") == "").alias("pairs"), F.sum(missing).alias("missing"), F.sum("extras").alias("extras"))


def visual_artifacts(raw: DataFrame, annotated: DataFrame, key: list[str]) -> DataFrame:
    """The whole report on artifacts, one row per collection of ``raw`` (style_hex, area, role): its white fragments and masks, and of the primary features ``annotated``
    (of :func:`annotate`, with rings and area, told apart by ``key``) their shapes, holes by class, voids and candidates.

    Holes, features and fragments are counted apart and then joined, one row per collection each. Collections without primary features have zeros; null areas and
    roles count as none; a feature without rings has no holes. Areas are summed to three digits.
    """
    area, count = lambda c: F.coalesce(F.sum(c.cast("decimal(18,3)")), F.lit(0)).cast("decimal(18,3)"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    white = s.near_white(F.col("style_hex"))
    fragments = raw.groupBy("collection_id").agg(count(white).alias("white_fragments"), area(F.when(white, F.col("area"))).alias("white_area"), count(F.col("role") == "background_mask_fragment").alias("background_masks"))
    review = lambda flag: count(F.array_contains("flags", flag))
    shapes = p.void_metrics(annotated).groupBy("collection_id").agg(
        count(white).alias("trusted_white"), F.round(F.max("spike"), 4).alias("max_spike"), count(F.col("spike") >= 0.55).alias("spikes"), review("needle_spike_candidate").alias("spike_reviews"),
        count(F.col("needle")).alias("needles"), count(F.col("sliver")).alias("slivers"), count(F.col("corridor")).alias("corridors"), F.sum("triangular").alias("triangular_voids"), F.sum("small").alias("small_voids"),
        F.sum("to_review").alias("void_reviews"), area(F.col("area")).alias("_area"), count(~F.col("export_eligible")).alias("export_blocked"), review("artifact_requires_review").alias("artifact_reviews"),
    )
    holes = e.hole_classes(annotated.select(*key, "rings")).withColumn("_box", g.bbox_area(g.bbox(F.array("hole"))))
    rect = (F.col("hole_area") > 0) & (F.col("_box") > 0) & (F.abs(F.col("hole_area") - F.col("_box")) / F.greatest("_box", F.lit(1.0)) <= 0.08)
    per = holes.groupBy(*key).agg(
        F.count("*").alias("holes"), count(rect).alias("rectangular"), area(F.when(rect, F.col("hole_area"))).alias("rect_area"), area(F.col("hole_area")).alias("_void"), count(F.col("removable")).alias("removed_holes"),
        *[count(F.col("hole_class") == c).alias(n) for c, n in HOLE_COUNTS],
    )
    sums = ["holes", "rectangular", "rect_area", "_void", "removed_holes", *[n for _, n in HOLE_COUNTS]]
    of_holes = per.groupBy("collection_id").agg(*[F.sum(c).alias(c) for c in sums], count(F.col("removed_holes") > 0).alias("cleaned_candidates"))
    rows = fragments.join(shapes.hint("shuffle_hash"), "collection_id", "left").join(of_holes.hint("shuffle_hash"), "collection_id", "left").na.fill(0)
    share = lambda c: F.col(c).cast("double") / F.greatest((F.col("_area") + F.col(c)).cast("double"), F.lit(1.0))
    rows = rows.withColumn("rect_ratio", F.round(share("rect_area"), 6)).withColumn("void_ratio", F.round(share("_void"), 6))
    rows = rows.withColumn("rect_reviews", F.when(share("rect_area") >= 0.025, F.col("rectangular")).otherwise(0)).withColumn("hole_reviews", F.col("unknown_holes"))
    matches = F.when(F.col("void_reviews") > 0, "requires_plan_visual_review").otherwise("not_applicable")
    return rows.withColumn("void_matches_plan", matches).withColumn("void_source", F.when(F.col("holes") > 0, "interior_ring_from_merged_fill")).drop("_area", "_void")
