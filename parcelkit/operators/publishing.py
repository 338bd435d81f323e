"""From reviewed polygons to published ones: remapping with overrides, edits judged by their geometry, core rows, their GeoJSON, and the rules that all rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.folders import written
from . import documents as d

#: Tables of names up to this many rows go to all tasks; larger ones are joined by a shuffle.
SMALL = 20_000
TYPE_NUMBERS = {"STAV": "1", "NAVRH": "2", "REZERVA": "3"}


def class_type(cls: Column, kind: Column) -> Column:
    """Class and number of the type, 0 for any other type."""
    number = F.lit("0")
    for name, n in TYPE_NUMBERS.items():
        number = F.when(F.upper(kind) == name, n).otherwise(number)
    return F.concat_ws(".", cls, number)


def beside(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with ``names`` on ``keys`` (null keys are equal): by broadcast if ``names``, written once, is SMALL, else by a shuffle whose skewed parts Spark splits."""
    names = written(names.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in names.columns]), "names")
    few = names.limit(SMALL + 1).count() <= SMALL
    same = [rows[k].eqNullSafe(names[f"_{k}"]) for k in keys]
    return rows.join(names.hint("broadcast" if few else "shuffle_hash"), same, "left").drop(*[f"_{k}" for k in keys])


def override_violations(layer: Column, cls: Column, note: Column, label: Column) -> Column:
    """The rules that an override breaks: a note is needed for layers that start with CUST and classes that start with X, a label too for layer CUST. Blank counts as missing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    needs = F.coalesce(layer.startswith("CUST") | cls.startswith("X"), F.lit(False))
    custom = F.coalesce(layer == "CUST", F.lit(False))
    return F.filter(F.array(F.when(needs & blank(note), F.lit("custom_note_required")), F.when(custom & blank(label), F.lit("custom_label_required"))), lambda x: x.isNotNull())


def check_overrides(overrides: DataFrame) -> DataFrame:
    """``overrides`` (override_layer, override_class, note, override_label) with violations, empty where they may be applied."""
    return overrides.withColumn("violations", override_violations(*[F.col(c) for c in ("override_layer", "override_class", "note", "override_label")]))


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """The last override that breaks no rule for every (collection_id, target_kind, target_id), by ts, then by override_id."""
    fields = ["override_id", "override_layer", "override_class", "override_type", "override_group", "override_label", "note"]
    last = F.max_by(F.struct(*fields), F.struct("ts", "override_id")).alias("o")
    good = check_overrides(overrides).where(F.size("violations") == 0)
    return good.groupBy("collection_id", "target_kind", "target_id").agg(last).select("collection_id", "target_kind", "target_id", "o.*")


def remap_features(features: DataFrame, classes: DataFrame, groups: DataFrame, overrides: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``features`` (collection_id, fid, layer, class, type_text, ref; columns of ``keep`` too) with proposed_layer, _class, _type, _layer_class, _class_type, group_label, display_label, rule, score, review.

    An override of the feature wins with score 1; then a listed class, a custom one with a ref, else UNMAPPED. ``classes``: (layer_class, label); ``groups``: (prefix, label).
    ``overrides``: of latest_overrides. Labels and groups are looked up once for each distinct (layer, class).
    """
    names = d.longest_prefix(features.select("layer", "class").distinct(), groups).withColumnRenamed("key", "layer_class")
    names = names.join(classes.hint("shuffle_hash"), "layer_class", "left").select("layer", "class", "layer_class", "group_label", "label")
    rows = d.infer_type(beside(features, names, ["layer", "class"]))
    listed, ref = F.col("label").isNotNull(), F.nullif(F.col("ref"), F.lit(""))
    is_custom = F.col("layer_class").startswith("CUST.")
    custom, unsure = is_custom & ref.isNotNull(), F.col("type_score") < 0.8
    cls = F.when(listed | custom, F.coalesce("class", F.lit("UNMAPPED"))).otherwise("UNMAPPED")
    layer = F.coalesce("layer", F.lit("UNCLASSIFIED"))
    auto = {
        "proposed_layer": layer, "proposed_class": cls, "proposed_type": F.col("type"), "proposed_layer_class": F.concat_ws(".", layer, cls), "proposed_class_type": class_type(cls, F.col("type")), "group_label": F.col("group_label"),
        "display_label": F.when(listed & ref.isNotNull(), F.concat("label", F.lit(" ("), ref, F.lit(")"))).when(listed, F.col("label")).when(custom, F.concat("layer_class", F.lit(" - "), ref)),
        "rule": F.when(listed, "class_map").when(custom, "custom_ref").otherwise("unmapped"), "score": F.when(listed, F.least(F.lit(0.96), 0.75 + F.col("type_score") / 4)).when(custom, 0.78).otherwise(F.col("type_score") / 2),
        "review": F.when(listed, unsure | (is_custom & ref.isNull())).when(custom, unsure).otherwise(True),
    }
    if overrides is None:
        return rows.select("collection_id", "fid", *keep, *[c.alias(n) for n, c in auto.items()])
    said = overrides.where("target_kind = 'feature'").withColumnRenamed("target_id", "fid").drop("target_kind")
    rows = rows.join(said.hint("shuffle_hash"), ["collection_id", "fid"], "left")
    o = {
        "proposed_layer": F.col("override_layer"), "proposed_class": F.col("override_class"), "proposed_type": F.col("override_type"), "proposed_layer_class": F.concat_ws(".", "override_layer", "override_class"),
        "proposed_class_type": class_type(F.col("override_class"), F.col("override_type")), "group_label": F.col("override_group"), "display_label": F.col("override_label"),
        "rule": F.lit("manual_override"), "score": F.lit(1.0), "review": F.lit(False),
    }
    return rows.select("collection_id", "fid", *keep, *[F.when(F.col("override_id").isNotNull(), o[n]).otherwise(c).alias(n) for n, c in auto.items()])


def definition_candidates(features: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per vector key (style, layer, class, type, has_fill) and per text key (layer, class, type, text_id) of a collection, each with its count, its first feature, and how that one is remapped.

    ``features``: collection_id, fid, layer, class, type_text, text_id, style_hex, has_fill. text_role is change_label for layer ZMEN, else source_label, and null for
    vector keys; a missing style is not_exposed. Features without text_id give no text key. Two aggregates, one remap over their union.
    """
    f = features.withColumn("source_style_key", F.coalesce("style_hex", F.lit("not_exposed"))).withColumn("ref", F.nullif(F.col("text_id"), F.lit("")))
    count = [F.count("*").alias("sample_count"), F.min("fid").alias("fid")]
    vector = f.groupBy("collection_id", "source_style_key", "layer", "class", "type_text", "has_fill").agg(*count, F.min_by("ref", "fid").alias("ref")).withColumn("kind", F.lit("vector"))
    texts = f.where("ref is not null").groupBy("collection_id", "layer", "class", "type_text", "ref").agg(*count).withColumn("kind", F.lit("text")).withColumn("sample_text", F.col("ref"))
    texts = texts.withColumn("text_role", F.when(F.col("layer") == "ZMEN", "change_label").otherwise("source_label"))
    rows = written(vector.unionByName(texts, allowMissingColumns=True), "candidates")
    keep = ("kind", "source_style_key", "has_fill", "sample_text", "text_role", "sample_count", "layer", "class", "type_text")
    return remap_features(rows, classes, groups, keep=keep).withColumnRenamed("fid", "first_fid")


def validate_polygon_edits(edits: DataFrame, most: float = 25.0) -> DataFrame:
    """``edits`` (geometry_type, rings_before, rings_after, note) with area_before, area_after, change, errors and status.

    An edit must give one polygon with a closed outer ring and an area; else it is invalid and errors tells why. change is in percent of the area before
    (100 where there was none, 0 where there is none after either); above ``most`` a note is needed. Null or empty rings have no area.
    """
    outer = F.get("rings_after", F.lit(0))
    area = lambda c: F.coalesce(g.polygon_area(F.col(c)), F.lit(0.0))
    rows = edits.withColumn("area_before", area("rings_before")).withColumn("area_after", area("rings_after")).withColumn("_closed", g.is_closed(outer))
    a, b = F.col("area_after"), F.col("area_before")
    errors = [(F.coalesce(F.col("geometry_type") != "Polygon", F.lit(True)), "not_a_polygon"), (~F.col("_closed"), "ring_not_closed"), (~F.col("_closed") | (a <= 0), "no_positive_area")]
    rows = rows.withColumn("errors", F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in errors]), lambda x: x.isNotNull()))
    rows = rows.withColumn("change", F.when(b > 0, F.abs(a - b) / b * 100.0).otherwise(F.when(a > 0, 100.0).otherwise(0.0)))
    blank = F.coalesce(F.trim("note"), F.lit("")) == ""
    return rows.withColumn("status", F.when(F.size("errors") > 0, "invalid").when((F.col("change") > most) & blank, "needs_note").otherwise("saved")).drop("_closed")


def core_rows(staging: DataFrame, reviews: DataFrame, edits: DataFrame, overrides: DataFrame) -> DataFrame:
    """The published rows: ``staging`` polygons whose last review approves them.

    ``staging``: collection_id, fid, stg_polygon_id, up_id, layer, class, type, text_id, rings, source_page, source_algorithm_id, confidence. ``reviews``: stg_polygon_id, review_id, ts, decision, reviewed_by.
    ``edits``: manual_edit_id, stg_polygon_id, ts and what validate_polygon_edits takes; the last saved one replaces the geometry. ``overrides``: of
    latest_overrides; the label stands beside text_id and never replaces it. One shuffle by stg_polygon_id serves all three joins of it.
    """
    last = lambda value, order: F.max_by(F.struct(*value), F.struct("ts", order))
    said = reviews.groupBy("stg_polygon_id").agg(last(["decision", "reviewed_by", F.col("ts").alias("reviewed_at")], "review_id").alias("r")).where("r.decision = 'approved'").select("stg_polygon_id", "r.reviewed_by", "r.reviewed_at")
    saved = validate_polygon_edits(edits).where("status = 'saved'").groupBy("stg_polygon_id").agg(last(["manual_edit_id", "rings_after"], "manual_edit_id").alias("e")).select("stg_polygon_id", "e.*")
    labels = overrides.where("target_kind = 'feature'").select("collection_id", F.col("target_id").alias("fid"), F.col("override_label").alias("label_override"))
    rows = staging.join(said.hint("shuffle_hash"), "stg_polygon_id").join(saved.hint("shuffle_hash"), "stg_polygon_id", "left").join(labels.hint("shuffle_hash"), ["collection_id", "fid"], "left")
    rows = rows.withColumn("rings", F.coalesce("rings_after", "rings"))
    return rows.select(
        "collection_id", "fid", "up_id", F.concat_ws(":", "up_id", "layer", "class", "type").alias("up_type_id"), "layer", "class", "type", F.concat_ws(".", "layer", "class").alias("layer_class"), class_type(F.col("class"), F.col("type")).alias("class_type"),
        "text_id", "rings", g.is_closed(F.get("rings", F.lit(0))).alias("is_closed"), F.col("stg_polygon_id").alias("source_stg_polygon_id"), "manual_edit_id", "label_override", F.lit("approved").alias("review_status"), "reviewed_by", "reviewed_at",
        "source_page", "source_algorithm_id", F.col("confidence").alias("source_confidence"),
    )


def core_geojson(core: DataFrame) -> DataFrame:
    """(collection_id, fid, feature): core rows as the JSON text of a feature with 13 properties and its polygon; null properties stay, null rings give a null geometry."""
    names = {
        "FID": "fid", "up_id": "up_id", "up_type_id": "up_type_id", "LAYER": "layer", "CLASS": "class", "TYPE": "type", "LAYER_CLASS": "layer_class", "class_type": "class_type", "text_id": "text_id",
        "IS_CLOSED": "is_closed", "label_override": "label_override", "review_status": "review_status", "source_algorithm_id": "source_algorithm_id",
    }
    fid = F.col("fid").cast("string")
    properties = F.struct(*[(fid if c == "fid" else F.col(c)).alias(n) for n, c in names.items()])
    coordinates = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    shape = F.when(F.col("rings").isNotNull(), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")))
    body = F.struct(F.lit("Feature").alias("type"), fid.alias("id"), properties.alias("properties"), shape.alias("geometry"))
    return core.select("collection_id", "fid", F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def _outside(column: str, *names: str) -> Column:
    return ~F.col(column).isin(*names)


def rules(table: str) -> dict[str, Column]:
    """The rules of ``table``: name and the condition that breaks it. A null condition breaks nothing."""
    polygon = F.col("geometry_type") != "Polygon"
    return {
        "definitions": {
            "no_fake_crs": F.col("coordinate_system") == "EPSG:5514", "zmen_is_navrh": (F.col("layer") == "ZMEN") & (F.col("type") != "NAVRH"),
            "zmen_has_no_fill": (F.col("layer") == "ZMEN") & F.col("has_fill"), "custom_has_ref": F.col("is_custom") & F.col("ref").isNull(),
        },
        "staging": {"staging_polygon_only": polygon},
        "edits": {"edit_polygon_only": polygon},
        "core": {
            "core_polygon_only": polygon, "core_class_type": F.col("class_type") != class_type(F.col("class"), F.col("type")), "core_not_in_review": F.col("review_status") == "review_required",
        },
        "residuals": {"residual_type": _outside("residual_type", "missing", "extra")},
        "reviews": {"review_decision": _outside("decision", "approved", "rejected", "corrected", "needs_more_evidence")},
        "overrides": {
            "override_target_kind": _outside("target_kind", "vector_def", "text_def", "feature", "profile"), "override_custom_note": (F.col("override_layer") == "CUST") & (F.col("note").isNull() | F.col("override_label").isNull()),
        },
    }[table]


def rule_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(collection_id, rule, n) for every rule of the given tables, 0 included: one aggregate a table, whatever its number of rules."""
    parts = []
    for name, rows in tables.items():
        own = rules(name)
        counted = rows.groupBy("collection_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in own.items()])
        parts.append(counted.unpivot("collection_id", list(own), "rule", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_violations(rows: DataFrame, table: str) -> DataFrame:
    """The rows of ``table`` that break a rule, one for each rule they break (rule is added)."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules(table).items()]), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken))
