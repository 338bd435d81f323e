"""Queries on remapping with overrides, judged edits, published rows and their rules, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.vocabulary import CLASS_GROUPS, CLASS_LABELS
from ..operators import publishing as p
from .catalogue import TYPED, query
from .views import view

FEATURES, EVENTS = ("v_features",), ("v_review_events",)
#: Events of a feature: its fid comes from the user and the last digit of the event, so that targets have several events.
EV = ", ev AS (SELECT * REPLACE (CAST(target_id * 100 + event_id % 10 AS BIGINT) AS target_id, CAST((target_id * 100 + event_id % 10) % 8 AS INTEGER) AS collection_id) FROM v_review_events)"
OV = EV + """, ov AS (SELECT collection_id, target_id, event_id AS override_id, ts, CASE WHEN event_id % 97 = 5 THEN 'page' WHEN event_id % 10 = 9 THEN 'profile' ELSE 'feature' END AS target_kind,
CASE event_id % 4 WHEN 0 THEN 'RZVP' WHEN 1 THEN 'ZMEN' WHEN 2 THEN 'CUST' ELSE 'CUSTOM' END AS override_layer, CASE event_id % 5 WHEN 0 THEN 'BI' WHEN 1 THEN 'SV' WHEN 2 THEN 'X' WHEN 3 THEN 'XZ' ELSE 'K' END AS override_class,
CASE event_id % 3 WHEN 0 THEN 'STAV' WHEN 1 THEN 'NAVRH' ELSE 'none' END AS override_type, CASE WHEN event_id % 6 <> 2 THEN 'label ' || CAST(event_id % 9 AS VARCHAR) END AS override_label,
CASE WHEN event_id % 7 < 4 THEN note_json WHEN event_id % 7 = 4 THEN ' ' END AS note FROM ev WHERE action = 'override'),
ok AS (SELECT *, (override_layer LIKE 'CUST%' OR override_class LIKE 'X%') AND coalesce(trim(note), '') = '' AS no_note, override_layer = 'CUST' AND coalesce(trim(override_label), '') = '' AS no_label FROM ov),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, target_kind, target_id ORDER BY ts DESC, override_id DESC) AS k FROM ok WHERE NOT no_note AND NOT no_label) WHERE k = 1)"""
ED = """, ed AS (SELECT event_id AS manual_edit_id, target_id AS stg_polygon_id, collection_id, ts, CASE WHEN event_id % 11 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type, floor(area_after) / 8 AS h,
event_id % 7 = 0 AS opened, CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS area_before, CASE event_id % 3 WHEN 0 THEN note_json WHEN 1 THEN '  ' END AS note FROM ev WHERE action = 'edit'),
ju AS (SELECT *, 10 * h AS area_after, CASE WHEN area_before > 0 THEN abs(10 * h - area_before) / area_before * 100 WHEN h > 0 THEN 100 ELSE 0 END AS change,
concat_ws(',', CASE WHEN geometry_type <> 'Polygon' THEN 'not_a_polygon' END, CASE WHEN opened AND h > 0 THEN 'ring_not_closed' END, CASE WHEN opened AND h > 0 OR h <= 0 THEN 'no_positive_area' END) AS errors FROM ed),
st AS (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN change > 25 AND coalesce(trim(note), '') = '' THEN 'needs_note' ELSE 'saved' END AS status FROM ju)"""


def _events(spark, sf_dir, action):
    fid = F.col("target_id") * 100 + F.col("event_id") % 10
    rows = view(spark, sf_dir, "v_review_events").where(F.col("action").isin(action))
    return rows.withColumns({"target_id": fid, "collection_id": (fid % 8).cast("int")})


def _cases(number, values):
    """The value at ``number``; None gives null."""
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def _overrides(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(n % 97 == 5, "page").when(n % 10 == 9, "profile").otherwise("feature")
    return _events(spark, sf_dir, "override").select(
        "collection_id", "target_id", n.alias("override_id"), "ts", kind.alias("target_kind"), _cases(n % 4, ["RZVP", "ZMEN", "CUST", "CUSTOM"]).alias("override_layer"),
        _cases(n % 5, ["BI", "SV", "X", "XZ", "K"]).alias("override_class"), _cases(n % 3, ["STAV", "NAVRH", "none"]).alias("override_type"), F.lit(None).cast("string").alias("override_group"),
        F.when(n % 6 != 2, F.concat(F.lit("label "), (n % 9).cast("string"))).alias("override_label"), F.when(n % 7 < 4, F.col("note_json")).when(n % 7 == 4, " ").alias("note"),
    )


def _box(w, h):
    return g.point(F.lit(0.0), F.lit(0.0)), g.point(w, F.lit(0.0)), g.point(w, h), g.point(F.lit(0.0), h)


def _edits(spark, sf_dir):
    """Edits to a box of ten by an eighth of the event's value; every seventh ring is left open, every eleventh is no polygon."""
    n, h = F.col("event_id"), F.floor("area_after") / 8.0
    corners = _box(F.lit(10.0), h)
    after = F.when(n % 7 == 0, F.array(F.array(*corners))).otherwise(F.array(F.array(*corners, corners[0])))
    old = _box(F.lit(10.0), F.lit(10.0))
    before = F.when(n % 13 != 0, F.array(F.array(*old, old[0])))
    kind = F.when(n % 11 == 0, "MultiPolygon").otherwise("Polygon")
    return _events(spark, sf_dir, "edit").select(n.alias("manual_edit_id"), F.col("target_id").alias("stg_polygon_id"), "collection_id", "ts", kind.alias("geometry_type"), before.alias("rings_before"), after.alias("rings_after"), F.when(n % 3 == 0, F.col("note_json")).when(n % 3 == 1, "  ").alias("note"))


def _features(spark, sf_dir):
    return view(spark, sf_dir, "v_features").withColumns({"collection_id": (F.col("fid") % 8).cast("int"), "ref": F.col("text_id")})


def _vocabulary(spark):
    return spark.createDataFrame(list(CLASS_LABELS.items()), "layer_class string, label string"), spark.createDataFrame(list(CLASS_GROUPS.items()), "prefix string, label string")


OVERRIDE = ["collection_id", "target_kind", "target_id", "override_id", "override_layer", "override_class", "override_type", "override_label", "note"]


@query("j8_applied_overrides", OV + f" SELECT {', '.join(OVERRIDE)} FROM la", EVENTS)
def _j8_applied(spark, sf_dir):
    return p.latest_overrides(_overrides(spark, sf_dir)).select(*OVERRIDE)


@query("j8_override_violations", OV + " SELECT override_id, 'custom_note_required' AS violation FROM ok WHERE no_note UNION ALL SELECT override_id, 'custom_label_required' FROM ok WHERE no_label", EVENTS)
def _j8_violations(spark, sf_dir):
    return p.check_overrides(_overrides(spark, sf_dir)).select("override_id", F.explode("violations").alias("violation"))


VALUES = ", cv(layer_class, label) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CLASS_LABELS.items()) + "), gv(prefix, label) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CLASS_GROUPS.items()) + ")"
NUMBER = "CASE upper({t}) WHEN 'STAV' THEN '1' WHEN 'NAVRH' THEN '2' WHEN 'REZERVA' THEN '3' ELSE '0' END"
REMAPPED = TYPED + OV + VALUES + f""", nk AS (SELECT DISTINCT layer, class, layer || '.' || coalesce(class, 'UNMAPPED') AS layer_class FROM y),
nm AS (SELECT nk.*, cv.label, (SELECT arg_max(gv.label, length(gv.prefix)) FROM gv WHERE starts_with(nk.layer_class, gv.prefix)) AS group_label FROM nk LEFT JOIN cv USING (layer_class)),
au AS (SELECT y.fid, CAST(y.fid % 8 AS INTEGER) AS collection_id, y.layer, y.class, y.text_id AS ref, y.type, y.type_score, nm.layer_class, nm.label, nm.group_label, nm.label IS NOT NULL AS listed, starts_with(nm.layer_class, 'CUST.') AS cust FROM y JOIN nm ON y.layer = nm.layer AND y.class IS NOT DISTINCT FROM nm.class),
av AS (SELECT *, CASE WHEN listed OR (cust AND ref IS NOT NULL) THEN coalesce(class, 'UNMAPPED') ELSE 'UNMAPPED' END AS pc, CASE WHEN listed THEN 'class_map' WHEN cust AND ref IS NOT NULL THEN 'custom_ref' ELSE 'unmapped' END AS rule FROM au),
rm AS (SELECT av.collection_id, av.fid, o.override_id IS NOT NULL AS over, coalesce(o.override_layer, av.layer) AS proposed_layer, coalesce(o.override_class, pc) AS proposed_class, coalesce(o.override_type, type) AS proposed_type,
CASE WHEN over THEN NULL ELSE group_label END AS group_label, CASE WHEN over THEN o.override_label WHEN listed AND ref IS NOT NULL THEN label || ' (' || ref || ')' WHEN listed THEN label WHEN rule = 'custom_ref' THEN layer_class || ' - ' || ref END AS display_label,
CASE WHEN over THEN 'manual_override' ELSE rule END AS rule, CASE WHEN over THEN 1.0::DOUBLE WHEN listed THEN least(0.96::DOUBLE, 0.75::DOUBLE + type_score / 4) WHEN rule = 'custom_ref' THEN 0.78::DOUBLE ELSE type_score / 2 END AS score,
CASE WHEN over THEN false WHEN listed THEN type_score < 0.8::DOUBLE OR (cust AND ref IS NULL) WHEN rule = 'custom_ref' THEN type_score < 0.8::DOUBLE ELSE true END AS review
FROM av LEFT JOIN la o ON o.target_kind = 'feature' AND o.target_id = av.fid AND o.collection_id = av.collection_id)"""


@query("j6_remap_features", REMAPPED + f" SELECT * EXCLUDE (over), proposed_layer || '.' || proposed_class AS proposed_layer_class, proposed_class || '.' || {NUMBER.format(t='proposed_type')} AS proposed_class_type FROM rm", ("v_features", "v_review_events"))
def _j6_features(spark, sf_dir):
    return p.remap_features(_features(spark, sf_dir), *_vocabulary(spark), p.latest_overrides(_overrides(spark, sf_dir)))


CANDIDATES = TYPED + VALUES + """, f AS (SELECT *, CAST(fid % 8 AS INTEGER) AS coll, layer || '.' || coalesce(class, 'UNMAPPED') AS lc FROM y),
ca AS (SELECT 'vector' AS kind, coll, coalesce(style_hex, 'not_exposed') AS source_style_key, style_hex IS NOT NULL AS has_fill, NULL AS sample_text, NULL AS text_role, layer, class, type_text, count(*) AS sample_count, min(fid) AS first_fid FROM f GROUP BY ALL
UNION ALL SELECT 'text', coll, NULL, NULL, text_id, CASE WHEN layer = 'ZMEN' THEN 'change_label' ELSE 'source_label' END, layer, class, type_text, count(*), min(fid) FROM f WHERE text_id IS NOT NULL GROUP BY ALL)
SELECT ca.kind, ca.coll AS collection_id, ca.source_style_key, ca.has_fill, ca.sample_text, ca.text_role, ca.layer, ca.class, ca.type_text, ca.sample_count, ca.first_fid,
CASE WHEN cv.label IS NOT NULL THEN 'class_map' WHEN f.layer = 'CUST' AND f.text_id IS NOT NULL THEN 'custom_ref' ELSE 'unmapped' END AS rule, f.type AS proposed_type,
CASE WHEN cv.label IS NOT NULL THEN least(0.96::DOUBLE, 0.75::DOUBLE + f.type_score / 4) WHEN f.layer = 'CUST' AND f.text_id IS NOT NULL THEN 0.78::DOUBLE ELSE f.type_score / 2 END AS score
FROM ca JOIN f ON f.fid = ca.first_fid LEFT JOIN cv ON cv.layer_class = f.lc"""


@query("e13_whole_candidates", CANDIDATES, FEATURES)
def _e13_whole(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("has_fill", F.col("style_hex").isNotNull())
    out = p.definition_candidates(rows, *_vocabulary(spark))
    return out.drop("proposed_layer", "proposed_class", "proposed_layer_class", "proposed_class_type", "group_label", "display_label", "review")


@query("m1_polygon_edits", EV + ED + " SELECT manual_edit_id, area_before, area_after, change, errors, status FROM st", EVENTS)
def _m1_polygons(spark, sf_dir):
    rows = p.validate_polygon_edits(_edits(spark, sf_dir))
    return rows.select("manual_edit_id", "area_before", "area_after", "change", F.array_join("errors", ",").alias("errors"), "status")


#: Published rows: the staging polygon is a box of five by an eighth of the feature's number; decisions come from two kinds of events.
REVIEWS = """, rv AS (SELECT event_id AS review_id, target_id AS stg_polygon_id, collection_id, ts, CASE WHEN event_id % 50 = 3 THEN 'maybe' WHEN action = 'approve' THEN 'approved' WHEN event_id % 4 = 0 THEN 'rejected' WHEN event_id % 4 = 1 THEN 'needs_more_evidence' ELSE 'corrected' END AS decision FROM ev WHERE action IN ('approve', 'annotate'))"""
CORE = OV + ED + REVIEWS + """, rl AS (SELECT stg_polygon_id, arg_max(decision, (ts, review_id)) AS decision FROM rv GROUP BY stg_polygon_id), el AS (SELECT stg_polygon_id, arg_max(h, (ts, manual_edit_id)) AS h, max_by(manual_edit_id, (ts, manual_edit_id)) AS manual_edit_id FROM st WHERE status = 'saved' GROUP BY stg_polygon_id),
sg AS (SELECT fid, CAST(fid % 8 AS INTEGER) AS collection_id, 'up-' || CAST(fid % 3 AS VARCHAR) AS up_id, layer, coalesce(class, 'UNMAPPED') AS class, CASE fid % 4 WHEN 0 THEN 'STAV' WHEN 1 THEN 'NAVRH' WHEN 2 THEN 'REZERVA' ELSE 'UNMAPPED' END AS type, text_id, (fid % 80 + 1) / 8 AS h0 FROM v_features),
co AS (SELECT sg.*, up_id || ':' || layer || ':' || class || ':' || type AS up_type_id, layer || '.' || class AS layer_class, class || '.' || """ + NUMBER.format(t="type") + """ AS class_type, el.manual_edit_id, la.override_label AS label_override, coalesce(el.h, h0) AS h, CASE WHEN el.h IS NULL THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END AS w
FROM sg JOIN rl ON rl.stg_polygon_id = sg.fid AND rl.decision = 'approved' LEFT JOIN el ON el.stg_polygon_id = sg.fid LEFT JOIN la ON la.target_kind = 'feature' AND la.target_id = sg.fid AND la.collection_id = sg.collection_id)"""  # fmt: skip


def _reviews(spark, sf_dir):
    n, action = F.col("event_id"), F.col("action")
    decision = F.when(n % 50 == 3, "maybe").when(action == "approve", "approved").when(n % 4 == 0, "rejected").when(n % 4 == 1, "needs_more_evidence").otherwise("corrected")
    return _events(spark, sf_dir, ["approve", "annotate"]).select(F.col("target_id").alias("stg_polygon_id"), n.alias("review_id"), "collection_id", "ts", decision.alias("decision"), F.lit("reviewer").alias("reviewed_by"))


def _staging(spark, sf_dir):
    fid = F.col("fid")
    corners = _box(F.lit(5.0), (fid % 80 + 1) / 8.0)
    return _features(spark, sf_dir).select(
        "collection_id", "fid", fid.alias("stg_polygon_id"), F.concat(F.lit("up-"), (fid % 3).cast("string")).alias("up_id"), "layer", F.coalesce("class", F.lit("UNMAPPED")).alias("class"), _cases(fid % 4, ["STAV", "NAVRH", "REZERVA", "UNMAPPED"]).alias("type"),
        "text_id", F.array(F.array(*corners, corners[0])).alias("rings"), F.lit(1).alias("source_page"), F.lit("vector_fill_style_polygon_v1").alias("source_algorithm_id"), F.lit(0.9).alias("confidence"),
    )


def _core(spark, sf_dir):
    return p.core_rows(_staging(spark, sf_dir), _reviews(spark, sf_dir), _edits(spark, sf_dir), p.latest_overrides(_overrides(spark, sf_dir)))


@query("m4_core_rows", CORE + " SELECT collection_id, fid, up_type_id, layer_class, class_type, text_id, manual_edit_id, label_override, h * w AS area FROM co", ("v_features", "v_review_events"))
def _m4_core(spark, sf_dir):
    return _core(spark, sf_dir).select("collection_id", "fid", "up_type_id", "layer_class", "class_type", "text_id", "manual_edit_id", "label_override", g.polygon_area(F.col("rings")).alias("area"))


@query(
    "a8_core_geojson",
    CORE + """ SELECT collection_id, fid, '{"type":"Feature","id":"' || fid || '","properties":{"FID":"' || fid || '","up_id":"' || up_id || '","up_type_id":"' || up_type_id || '","LAYER":"' || layer || '","CLASS":"' || class || '","TYPE":"' || type || '","LAYER_CLASS":"' || layer_class
    || '","class_type":"' || class_type || '","text_id":' || coalesce('"' || text_id || '"', 'null') || ',"IS_CLOSED":true,"label_override":' || coalesce('"' || label_override || '"', 'null') || ',"review_status":"approved","source_algorithm_id":"vector_fill_style_polygon_v1"},"geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],['
    || w || ',0.0],[' || w || ',' || h || '],[0.0,' || h || '],[0.0,0.0]]]}}' AS feature FROM co""",
    ("v_features", "v_review_events"),
)
def _a8_core(spark, sf_dir):
    return p.core_geojson(_core(spark, sf_dir))


#: Definitions with faults: every 50th has an invented reference system.
RULE_SQL = {
    "no_fake_crs": "df WHERE fid % 50 = 7", "zmen_is_navrh": "df WHERE layer = 'ZMEN' AND upper(type_text) <> 'NAVRH'", "zmen_has_no_fill": "df WHERE layer = 'ZMEN' AND style_hex IS NOT NULL", "custom_has_ref": "df WHERE layer = 'CUST' AND text_id IS NULL",
    "staging_polygon_only": "df WHERE fid % 40 = 3", "edit_polygon_only": "ed WHERE geometry_type <> 'Polygon'", "core_polygon_only": "df WHERE fid % 40 = 6", "core_class_type": "df WHERE fid % 2 = 0 AND fid % 6 = 4", "core_not_in_review": "df WHERE fid % 10 = 4",
    "residual_type": "df WHERE fid % 3 = 2", "review_decision": "rv WHERE decision = 'maybe'", "override_target_kind": "ov WHERE target_kind = 'page'", "override_custom_note": "ov WHERE override_layer = 'CUST' AND (note IS NULL OR override_label IS NULL)",
}


@query(
    "m5_rule_counts",
    OV + ED + REVIEWS + ", df AS (SELECT *, CAST(fid % 8 AS INTEGER) AS coll FROM v_features), b AS (" + " UNION ALL ".join(f"SELECT '{rule}' AS rule, {'coll' if sql.startswith('df') else 'collection_id'} AS collection_id, count(*) AS n FROM {sql} GROUP BY ALL" for rule, sql in RULE_SQL.items())
    + "), k AS (SELECT DISTINCT rule, r.collection_id FROM (VALUES " + ", ".join(f"('{rule}', '{sql.split()[0]}')" for rule, sql in RULE_SQL.items()) + ") v(rule, tab), (SELECT DISTINCT coll AS collection_id, 'df' AS tab FROM df WHERE true UNION SELECT DISTINCT collection_id, 'ed' FROM ed UNION SELECT DISTINCT collection_id, 'rv' FROM rv UNION SELECT DISTINCT collection_id, 'ov' FROM ov) r"
    " WHERE r.tab = v.tab AND (rule NOT LIKE 'core%' OR r.collection_id % 2 = 0)) SELECT k.collection_id, k.rule, coalesce(b.n, 0) AS n FROM k LEFT JOIN b USING (rule, collection_id)",
    ("v_features", "v_review_events"),
)
def _m5_rules(spark, sf_dir):
    f, fid = _features(spark, sf_dir), F.col("fid")
    shape = lambda n: F.when(fid % 40 == n, "MultiPolygon").otherwise("Polygon").alias("geometry_type")
    crs = F.when(fid % 50 == 7, "EPSG:5514").otherwise("PDF_PAGE_POINTS_Y_DOWN_NO_CRS").alias("coordinate_system")
    right = p.class_type(F.lit("BI"), F.lit("STAV"))
    tables = {
        "definitions": f.select("collection_id", crs, "layer", F.upper("type_text").alias("type"), F.col("style_hex").isNotNull().alias("has_fill"), (F.col("layer") == "CUST").alias("is_custom"), "ref"),
        "staging": f.select("collection_id", shape(3)), "edits": _edits(spark, sf_dir),
        "core": f.where(fid % 2 == 0).select("collection_id", shape(6), F.lit("BI").alias("class"), F.lit("STAV").alias("type"), F.when(fid % 6 == 4, "BI.2").otherwise(right).alias("class_type"), F.when(fid % 10 == 4, "review_required").otherwise("approved").alias("review_status")),
        "residuals": f.select("collection_id", _cases(fid % 3, ["missing", "extra", "odd"]).alias("residual_type")),
        "reviews": _reviews(spark, sf_dir), "overrides": _overrides(spark, sf_dir),
    }
    return p.rule_counts(tables)
