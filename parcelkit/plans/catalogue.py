"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import styles as s
from ..functions.vocabulary import CLASS_GROUPS
from ..operators import documents as d
from .views import view, with_views

LEGEND = (40.0, 600.0, 300.0, 1300.0)
AREA = "decimal(18,3)"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query (spark, sf_dir) -> DataFrame with its SQL over ``views``."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return f

    return keep


def _profile(spark, sf_dir):
    return d.geometry_profile(d.rings(view(spark, sf_dir, "v_fragments")))


FRAGMENTS = ("v_fragments",)
SHAPE = """, f AS (SELECT *, CASE WHEN shape = 'tri' THEN w * h / 2 ELSE w * h END AS outer_area, drawing_index % 5 = 0 AS holed FROM v_fragments)"""


@query("b1_closed_rings", SHAPE + " SELECT collection_id, shape, count(*) AS rings, count(*) AS closed FROM f GROUP BY collection_id, shape", FRAGMENTS)
def _b1(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("collection_id", "shape").agg(F.count("*").alias("rings"), F.count_if("closed").alias("closed"))


@query("b2_ring_area", SHAPE + " SELECT collection_id, shape, sum(CAST(outer_area AS DECIMAL(18,3))) AS signed, sum(CAST(outer_area AS DECIMAL(18,3))) AS absolute FROM f GROUP BY collection_id, shape", FRAGMENTS)
def _b2(spark, sf_dir):
    ring = F.get("rings", F.lit(0))
    rows = d.rings(view(spark, sf_dir, "v_fragments"))
    return rows.groupBy("collection_id", "shape").agg(F.sum(g.ring_area_signed(ring).cast(AREA)).alias("signed"), F.sum(g.ring_area_abs(ring).cast(AREA)).alias("absolute"))


@query("b3_polygon_area", SHAPE + " SELECT collection_id, fill_hex, count(*) AS polygons, sum(CAST(CASE WHEN holed THEN outer_area - w * h / 4 ELSE outer_area END AS DECIMAL(18,3))) AS area FROM f GROUP BY collection_id, fill_hex", FRAGMENTS)
def _b3(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("collection_id", "fill_hex").agg(F.count("*").alias("polygons"), F.sum(F.col("area").cast(AREA)).alias("area"))


@query("b4_perimeter", SHAPE + " SELECT collection_id, shape, sum(CAST(CASE WHEN shape = 'tri' THEN w + h + sqrt(w * w + h * h) ELSE 2 * (w + h) END AS DECIMAL(18,2))) AS perimeter FROM f GROUP BY collection_id, shape", FRAGMENTS)
def _b4(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("collection_id", "shape").agg(F.sum(F.col("perimeter").cast("decimal(18,2)")).alias("perimeter"))


@query("b5_extent", SHAPE + " SELECT collection_id, min(x0) AS x0, min(y0) AS y0, max(x0 + w) AS x1, max(y0 + h) AS y1 FROM f GROUP BY collection_id", FRAGMENTS)
def _b5(spark, sf_dir):
    b = F.col("bbox")
    return _profile(spark, sf_dir).groupBy("collection_id").agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


@query("b7_legend_overlap", SHAPE + " SELECT collection_id, count(*) AS touching, sum(CAST(greatest(least(x0 + w, 300.0::DOUBLE) - greatest(x0, 40.0::DOUBLE), 0) * greatest(least(y0 + h, 1300.0::DOUBLE) - greatest(y0, 600.0::DOUBLE), 0) AS DECIMAL(18,3))) AS overlap FROM f WHERE x0 <= 300 AND x0 + w >= 40 AND y0 <= 1300 AND y0 + h >= 600 GROUP BY collection_id", FRAGMENTS)
def _b7(spark, sf_dir):
    box = F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), LEGEND, strict=True)])
    b = F.col("bbox")
    rows = _profile(spark, sf_dir).where((b["x0"] <= LEGEND[2]) & (b["x1"] >= LEGEND[0]) & (b["y0"] <= LEGEND[3]) & (b["y1"] >= LEGEND[1]))
    return rows.groupBy("collection_id").agg(F.count("*").alias("touching"), F.sum(g.bbox_overlap(b, box).cast(AREA)).alias("overlap"))


@query("b10_centres_inside", SHAPE + " SELECT collection_id, shape, count(*) AS inside FROM f WHERE shape = 'rect' OR h > 0 GROUP BY collection_id, shape", FRAGMENTS)
def _b10(spark, sf_dir):
    """Points at three quarters of the width and half of the height lie inside triangles and rectangles alike."""
    rows = _profile(spark, sf_dir)
    return rows.where(g.point_in_ring(F.get("rings", F.lit(0)), F.col("x0") + F.col("w") * 0.75, F.col("y0") + F.col("h") * 0.5)).groupBy("collection_id", "shape").agg(F.count("*").alias("inside"))


@query("b13_label_points", SHAPE + " SELECT collection_id, shape, sum(CAST(x0 + CASE WHEN shape = 'tri' THEN w / 2 ELSE w * 2 / 5 END AS DECIMAL(18,2))) AS x FROM f GROUP BY collection_id, shape", FRAGMENTS)
def _b13(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("collection_id", "shape").agg(F.sum(F.round(F.col("label.x"), 6).cast("decimal(18,2)")).alias("x"))


@query("b14_point_counts", SHAPE + " SELECT collection_id, CASE WHEN shape = 'tri' THEN 4 ELSE 5 END AS points, count(*) AS n, sum(CASE WHEN holed THEN 1 ELSE 0 END) AS holes FROM f GROUP BY 1, 2", FRAGMENTS)
def _b14(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("collection_id", "points").agg(F.count("*").alias("n"), F.sum("holes").alias("holes"))


@query(
    "c1_select_page",
    """, p AS (SELECT *, upper(page_text) AS t FROM v_collections), q AS (SELECT *, CAST(10 * (CASE WHEN contains(t, 'HLAVNÍ VÝKRES') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'HLAVNI VYKRES') THEN 1 ELSE 0 END
    + CASE WHEN contains(t, 'ÚPLNÉ ZNĚNÍ') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'Z12') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'UPLNE ZNENI') THEN 1 ELSE 0 END) + least(drawing_count // 100, 10) AS INTEGER) AS score FROM p)
    SELECT collection_id, page_index, score FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY score DESC, page_index DESC) AS n FROM q) WHERE n = 1""",
    ("v_collections",),
)
def _c1(spark, sf_dir):
    return d.select_page(view(spark, sf_dir, "v_collections")).select("collection_id", "page_index", "score")


@query("c8_inventory", " SELECT collection_id, CAST(sum(drawing_count) AS BIGINT) AS drawings, CAST(sum(image_count) AS BIGINT) AS images, CAST(sum(text_span_count) AS BIGINT) AS spans FROM v_collections GROUP BY collection_id", ("v_collections",))
def _c8(spark, sf_dir):
    return view(spark, sf_dir, "v_collections").groupBy("collection_id").agg(F.sum("drawing_count").alias("drawings"), F.sum("image_count").alias("images"), F.sum("text_span_count").alias("spans"))


@query(
    "e2_color_classes",
    """, c AS (SELECT *, CAST('0x' || substr(fill_hex, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(fill_hex, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(fill_hex, 6, 2) AS INTEGER) AS b FROM v_fragments)
    SELECT collection_id, count(*) FILTER (least(r, g, b) >= 242 AND greatest(r, g, b) - least(r, g, b) <= 10) AS white, count(*) FILTER (greatest(r, g, b) <= 35 AND greatest(r, g, b) - least(r, g, b) <= 20) AS black,
    count(*) FILTER (r >= 180 AND g <= 110 AND b <= 110) AS red FROM c GROUP BY collection_id""",
    FRAGMENTS,
)
def _e2(spark, sf_dir):
    c = F.col("fill_hex")
    return view(spark, sf_dir, "v_fragments").groupBy("collection_id").agg(F.count_if(s.near_white(c)).alias("white"), F.count_if(s.near_black(c)).alias("black"), F.count_if(s.red_fill(c)).alias("red"))


DASHED = "CASE dashes WHEN '[4 2] 0' THEN '4,2;phase=0' WHEN '[1 1] 2' THEN '1,1;phase=2' ELSE 'solid' END"


@query("e3_dashes", f" SELECT collection_id, {DASHED} AS norm, CASE dashes WHEN '[1 1] 2' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS phase, count(*) AS n FROM v_fragments GROUP BY 1, 2, 3", FRAGMENTS)
def _e3(spark, sf_dir):
    return view(spark, sf_dir, "v_fragments").select("collection_id", s.dash(F.col("dashes")).alias("x")).groupBy("collection_id", "x.norm", "x.phase").agg(F.count("*").alias("n"))


@query(
    "e4_style_definitions",
    f""", k AS (SELECT *, {DASHED} AS dash_norm FROM v_fragments), n AS (SELECT *, row_number() OVER (PARTITION BY collection_id, fill_hex, stroke_hex, stroke_width, dash_norm ORDER BY drawing_index) AS nth FROM k)
    SELECT collection_id, fill_hex, stroke_hex, stroke_width, dash_norm, count(*) AS n, min(drawing_index) AS first_drawing, string_agg(CASE WHEN nth <= 8 THEN CAST(drawing_index AS VARCHAR) END, ',' ORDER BY drawing_index) AS samples
    FROM n GROUP BY collection_id, fill_hex, stroke_hex, stroke_width, dash_norm""",
    FRAGMENTS,
)
def _e4(spark, sf_dir):
    return d.style_definitions(view(spark, sf_dir, "v_fragments"))


CODED = r""", t AS (SELECT *, trim(raw_text) AS text, regexp_replace(upper(regexp_replace(trim(raw_text), '[^\x00-\x7F]', '', 'g')), '[^A-Z0-9.]', '', 'g') AS bare FROM v_spans WHERE trim(raw_text) <> ''),
c AS (SELECT *, CASE WHEN bare IN ('B','BI','BV','BH','BU','R','RI','RX','S','SO','SV','SC','SX') THEN bare WHEN bare IN ('BXC','BX.C') THEN 'BX.c' WHEN bare IN ('BXP','BX.P') THEN 'BX.p' WHEN bare IN ('BXR','BX.R') THEN 'BX.r' END AS code,
regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g') AS normalized FROM t)"""


@query("e7_text_specs", CODED + " SELECT collection_id, span_index, normalized, code, CASE WHEN code IS NOT NULL THEN 'code' ELSE 'text' END AS role, CAST(length(text) AS INTEGER) AS chars FROM c", ("v_spans",))
def _e7(spark, sf_dir):
    return d.text_specs(view(spark, sf_dir, "v_spans")).select("collection_id", "span_index", "normalized", "code", "role", "chars")


@query("e8_text_definitions", CODED + " SELECT collection_id, normalized, font_name, count(*) AS n, arg_min(text, span_index) AS sample, min(span_index) AS first_span FROM c GROUP BY ALL", ("v_spans",))
def _e8(spark, sf_dir):
    return d.text_definitions(d.text_specs(view(spark, sf_dir, "v_spans")))


@query("e10_target_codes", CODED + " SELECT collection_id, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY collection_id, code", ("v_spans",))
def _e10(spark, sf_dir):
    return d.text_specs(view(spark, sf_dir, "v_spans")).where("code is not null").groupBy("collection_id", "code").agg(F.count("*").alias("n"))


REGION = """, z AS (SELECT *, (x0 + x0 + w) / 2 AS cx, (y0 + y0 + h) / 2 AS cy, CASE WHEN shape = 'tri' THEN w * h / 2 ELSE w * h / 1 END AS area,
  greatest(least(x0 + w, 300.0::DOUBLE) - greatest(x0, 40.0::DOUBLE), 0) * greatest(least(y0 + h, 1300.0::DOUBLE) - greatest(y0, 600.0::DOUBLE), 0) AS shared FROM v_fragments),
r AS (SELECT *, CASE WHEN (cx BETWEEN 40 AND 300 AND cy BETWEEN 600 AND 1300) OR shared >= greatest(4.0::DOUBLE, w * h * 0.2::DOUBLE) THEN 'legend_candidate_region'
  WHEN cy <= 127.5 OR cy >= 1564 OR (cx >= 1080 AND cy <= 816) THEN 'title_block_region' WHEN cx >= 1056 AND cy >= 1105 THEN 'legend_or_title_margin_region' ELSE 'map_body_region' END AS region FROM z)"""


@query("f4_regions", REGION + " SELECT collection_id, region, count(*) AS n FROM r GROUP BY collection_id, region", FRAGMENTS)
def _f4(spark, sf_dir):
    return d.regions(view(spark, sf_dir, "v_fragments"), LEGEND).groupBy("collection_id", "region").agg(F.count("*").alias("n"))


CODES = "unnest(['B','BI','BV','BH','BU','BX.c','BX.p','BX.r','R','RI','RX','S','SO','SV','SC','SX'])"


@query(
    "f5_expected_rows",
    CODED + f""", a AS (SELECT collection_id, code, arg_min(span_index, (CASE WHEN (x0 + x1) / 2 BETWEEN 40 AND 300 AND (y0 + y1) / 2 BETWEEN 600 AND 1300 THEN 0 ELSE 1 END, span_index)) AS anchor,
    min(CASE WHEN (x0 + x1) / 2 BETWEEN 40 AND 300 AND (y0 + y1) / 2 BETWEEN 600 AND 1300 THEN 0 ELSE 1 END) AS out FROM c WHERE code IS NOT NULL GROUP BY collection_id, code),
    k AS (SELECT collection_id, {CODES} AS code FROM (SELECT DISTINCT collection_id FROM v_spans))
    SELECT k.collection_id, k.code, a.anchor, CASE a.out WHEN 0 THEN 0.45::DOUBLE WHEN 1 THEN 0.28::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM k LEFT JOIN a USING (collection_id, code)""",
    ("v_spans",),
)
def _f5(spark, sf_dir):
    return d.expected_legend_rows(view(spark, sf_dir, "v_spans"), LEGEND)


METRICS = (
    REGION
    + """, m AS (SELECT collection_id, median(area) AS median_area, median(h) AS median_height, median(w) AS median_width FROM r GROUP BY collection_id),
x AS (SELECT r.collection_id, count(*) AS n, any_value(median_area) AS median_area, any_value(median_height) AS median_height, any_value(median_width) AS median_width,
  count(*) FILTER (h <= greatest(3.0::DOUBLE, median_height * 1.6::DOUBLE)) / count(*) AS tiny_height_ratio, count(*) FILTER (area <= greatest(20.0::DOUBLE, median_area * 2.0::DOUBLE)) / count(*) AS tiny_area_ratio,
  count(*) FILTER (shape = 'tri') / count(*) AS triangular_ratio FROM r JOIN m USING (collection_id) GROUP BY r.collection_id),
mm AS (SELECT *, n >= 1000 AND median_area <= 30 AND tiny_height_ratio >= 0.55 AND triangular_ratio >= 0.65 AS detected FROM x)"""
)


@query(
    "h1_tessellation",
    METRICS + """, b AS (SELECT collection_id, sum(c) AS band_hits FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY c DESC, band) AS k FROM (SELECT collection_id, CAST(round_even(cy * 2, 0) AS BIGINT) AS band, count(*) AS c FROM r GROUP BY 1, 2)) WHERE k <= 50 GROUP BY 1),
    s AS (SELECT collection_id, max(c) AS style_hits FROM (SELECT collection_id, coalesce(fill_hex, 'none') AS f, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
    SELECT mm.*, CAST(band_hits AS BIGINT) AS band_hits, style_hits FROM mm JOIN b USING (collection_id) JOIN s USING (collection_id)""",
    FRAGMENTS,
)
def _h1(spark, sf_dir):
    return d.tessellation_metrics(view(spark, sf_dir, "v_fragments"), least=1000)


ROLES = METRICS + """, o AS (SELECT r.*, CASE WHEN region = 'legend_candidate_region' THEN 'legend_symbol_fragment' WHEN fill_hex = '#ffffff' AND w * h >= 1020000 THEN 'background_mask_fragment'
  WHEN fill_hex = '#ffffff' THEN 'text_mask_fragment' WHEN fill_hex IS NULL AND stroke_hex IS NOT NULL THEN 'linework_fragment' WHEN shape = 'rect' AND area <= greatest(30.0::DOUBLE, median_area * 4.0::DOUBLE) THEN 'hatch_fragment'
  WHEN detected AND (shape = 'tri' OR h <= greatest(3.0::DOUBLE, median_height * 1.8::DOUBLE) OR least(w, h) <= 1.5) THEN 'tessellated_area_fragment'
  WHEN region = 'map_body_region' THEN 'area_fill_candidate' ELSE 'unknown_fragment' END AS role FROM r JOIN mm USING (collection_id))"""


def _roles(spark, sf_dir):
    rows = d.regions(view(spark, sf_dir, "v_fragments"), LEGEND)
    return d.fragment_roles(rows, d.tessellation_metrics(rows, least=1000))


@query("h2_fragment_roles", ROLES + " SELECT collection_id, region, role, count(*) AS n, sum(CAST(area AS DECIMAL(18,3))) AS area FROM o GROUP BY collection_id, region, role", FRAGMENTS)
def _h2(spark, sf_dir):
    return _roles(spark, sf_dir).groupBy("collection_id", "region", "role").agg(F.count("*").alias("n"), F.sum(F.col("area").cast(AREA)).alias("area"))


@query("h3_merge_groups", ROLES + " SELECT collection_id, fill_hex, stroke_hex, count(*) AS n, sum(CAST(area AS DECIMAL(18,3))) AS area FROM o WHERE role IN ('area_fill_candidate', 'tessellated_area_fragment') AND region = 'map_body_region' GROUP BY ALL HAVING count(*) >= 2", FRAGMENTS)
def _h3(spark, sf_dir):
    return d.merge_groups(_roles(spark, sf_dir))


@query(
    "h6_nearest_labels",
    CODED + """, t2 AS (SELECT collection_id, span_index, (x0 + x1) / 2 AS tx, (y0 + y1) / 2 AS ty FROM c WHERE code IS NOT NULL),
    p AS (SELECT f.collection_id, f.drawing_index, t2.span_index, tx BETWEEN f.x0 - 18 AND f.x0 + w + 18 AND ty BETWEEN f.y0 - 18 AND f.y0 + h + 18 AS inside,
    sqrt((tx - (f.x0 + (f.x0 + w)) / 2) * (tx - (f.x0 + (f.x0 + w)) / 2) + (ty - (f.y0 + (f.y0 + h)) / 2) * (ty - (f.y0 + (f.y0 + h)) / 2)) AS away FROM v_fragments f JOIN t2 ON f.collection_id = t2.collection_id AND tx BETWEEN f.x0 - 60 AND f.x0 + w + 60 AND ty BETWEEN f.y0 - 60 AND f.y0 + h + 60),
    q AS (SELECT *, CASE WHEN inside THEN 0.0::DOUBLE ELSE away END AS score FROM p WHERE inside OR away <= 35)
    SELECT collection_id, drawing_index, span_index, score FROM (SELECT *, row_number() OVER (PARTITION BY collection_id, drawing_index ORDER BY score, span_index) AS k FROM q) WHERE k = 1""",
    ("v_spans", "v_fragments"),
)
def _h6(spark, sf_dir):
    return d.associate_labels(view(spark, sf_dir, "v_fragments"), view(spark, sf_dir, "v_spans"))


TYPED = r""", t AS (SELECT *, nullif(type_text, '') AS raw, lower(strip_accents(type_text)) AS folded FROM v_features),
h AS (SELECT *, CASE WHEN regexp_matches(folded, 'stabil|stav|zastaven') THEN 1 ELSE 0 END AS a, CASE WHEN regexp_matches(folded, 'navrh|zastaviteln|zmena') THEN 1 ELSE 0 END AS b, CASE WHEN regexp_matches(folded, 'rezerv') THEN 1 ELSE 0 END AS c FROM t),
y AS (SELECT *, CASE WHEN raw IS NULL AND layer = 'ZMEN' THEN 'NAVRH' WHEN raw IS NULL THEN 'UNMAPPED' WHEN upper(raw) IN ('STAV', 'NAVRH', 'REZERVA') THEN upper(raw) WHEN a + b + c = 1 THEN CASE WHEN a = 1 THEN 'STAV' WHEN b = 1 THEN 'NAVRH' ELSE 'REZERVA' END ELSE 'UNMAPPED' END AS type,
CASE WHEN raw IS NULL AND layer = 'ZMEN' THEN 0.9::DOUBLE WHEN raw IS NULL THEN 0.0::DOUBLE WHEN upper(raw) IN ('STAV', 'NAVRH', 'REZERVA') THEN 1.0::DOUBLE WHEN a + b + c = 1 THEN 0.82::DOUBLE WHEN a + b + c > 1 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS type_score FROM h)"""


@query("j4_infer_type", TYPED + " SELECT collection_id, layer, type_text, type, type_score, count(*) AS n FROM y GROUP BY ALL", ("v_features",))
def _j4(spark, sf_dir):
    rows = view(spark, sf_dir, "v_features").groupBy("collection_id", "layer", "type_text").agg(F.count("*").alias("n"))  # patterns once for each text
    return d.infer_type(rows).select("collection_id", "layer", "type_text", "type", "type_score", "n")


PREFIXES = list(CLASS_GROUPS.items())
PREFIX_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in PREFIXES)


@query(
    "j5_longest_prefix",
    f""", p(prefix, label) AS (VALUES {PREFIX_ROWS}), k AS (SELECT DISTINCT layer, class, layer || '.' || coalesce(class, 'UNMAPPED') AS key FROM v_features),
    g AS (SELECT k.layer, k.class, k.key, arg_max(label, length(prefix)) AS group_label FROM k LEFT JOIN p ON starts_with(k.key, p.prefix) GROUP BY ALL)
    SELECT f.collection_id, g.key, g.group_label, count(*) AS n FROM v_features f JOIN g ON f.layer = g.layer AND f.class IS NOT DISTINCT FROM g.class GROUP BY ALL""",
    ("v_features",),
)
def _j5(spark, sf_dir):
    prefixes = spark.createDataFrame(PREFIXES, "prefix string, label string")
    return d.longest_prefix(view(spark, sf_dir, "v_features"), prefixes).groupBy("collection_id", "key", "group_label").agg(F.count("*").alias("n"))


@query("m1_validate_edits", """, e AS (SELECT *, CASE WHEN area_before = 0 THEN 100.0::DOUBLE ELSE abs(area_after - area_before) / area_before * 100.0::DOUBLE END AS change FROM v_review_events WHERE action = 'edit')
SELECT event_id, collection_id, change, CASE WHEN area_after IS NULL OR area_after <= 0 THEN 'invalid' WHEN change > 25 AND coalesce(trim(note_json) = '', true) THEN 'needs_note' ELSE 'saved' END AS status FROM e""", ("v_review_events",))  # fmt: skip
def _m1(spark, sf_dir):
    return d.validate_edits(view(spark, sf_dir, "v_review_events")).select("event_id", "collection_id", "change", "status")


@query("m8_feature_counts", " SELECT collection_id, layer || '.' || coalesce(class, 'UNMAPPED') AS layer_class, coalesce(type_text, 'UNMAPPED') AS type, count(*) AS n FROM v_features GROUP BY ALL", ("v_features",))
def _m8(spark, sf_dir):
    key = F.concat_ws(".", "layer", F.coalesce("class", F.lit("UNMAPPED"))).alias("layer_class")
    return view(spark, sf_dir, "v_features").groupBy("collection_id", key, F.coalesce("type_text", F.lit("UNMAPPED")).alias("type")).agg(F.count("*").alias("n"))


@query("t3_latest_state", """ SELECT collection_id, target_id, n AS events, event_id, action, area_after FROM (SELECT *, count(*) OVER (PARTITION BY collection_id, target_id) AS n,
row_number() OVER (PARTITION BY collection_id, target_id ORDER BY ts DESC, event_id DESC) AS k FROM v_review_events) WHERE k = 1""", ("v_review_events",))  # fmt: skip
def _t3(spark, sf_dir):
    return d.latest_state(view(spark, sf_dir, "v_review_events"))


@query("a4_source_registry", r""", u AS (SELECT trim(raw_url) AS url FROM v_sources) SELECT url, count(*) AS times, regexp_matches(url, '^https?://') AS accepted, substr(sha256(url), 1, 16) AS name FROM u GROUP BY url""", ("v_sources",))
def _a4(spark, sf_dir):
    url = F.trim("raw_url").alias("url")
    rows = view(spark, sf_dir, "v_sources").groupBy(url).agg(F.count("*").alias("times"))
    return rows.select("url", "times", F.col("url").rlike("^https?://").alias("accepted"), F.substring(F.sha2("url", 256), 1, 16).alias("name"))


@query("a5_fingerprint_ids", """, k AS (SELECT source_id, sha256('{"content_type":"' || content_type || '","n_chars":' || CAST(n_chars AS VARCHAR) || ',"url":"' || url || '"}') AS h FROM v_sources)
SELECT source_id, 'run-' || substr(h, 1, 12) AS run_id, 'collection-' || substr(h, 13, 12) AS collection FROM k""", ("v_sources",))  # fmt: skip
def _a5(spark, sf_dir):
    h = F.sha2(F.to_json(F.struct("content_type", "n_chars", "url")), 256)
    return view(spark, sf_dir, "v_sources").select("source_id", F.concat(F.lit("run-"), F.substring(h, 1, 12)).alias("run_id"), F.concat(F.lit("collection-"), F.substring(h, 13, 12)).alias("collection"))
