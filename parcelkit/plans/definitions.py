"""Queries on whole styles, merge groups and tessellation scores, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import definitions as f
from ..operators import documents as d
from .catalogue import DASHED, FRAGMENTS, METRICS, query
from .views import view

#: Drawings with all parts of a style. Each filled one gives a feature, every seventh four, every eleventh none.
DRAWN = f""", dr AS (SELECT collection_id, drawing_index, fill_hex, stroke_hex, CASE WHEN drawing_index % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS fill_opacity, CASE WHEN stroke_hex IS NOT NULL THEN 1.0::DOUBLE END AS stroke_opacity, CASE WHEN stroke_width > 1.6 THEN 1.6::DOUBLE ELSE 0.8::DOUBLE END AS stroke_width,
{DASHED} AS dash_norm, CASE drawing_index % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'text' END AS layer, CASE WHEN shape = 'tri' THEN 'c=1,l=3' ELSE 're=1' END AS path_ops, fill_hex IS NOT NULL AS is_filled, stroke_hex IS NOT NULL AS is_stroked, w, h, x0, y0, shape,
CASE WHEN fill_hex IS NULL OR drawing_index % 11 = 0 THEN 0 WHEN drawing_index % 7 = 0 THEN 4 ELSE 1 END AS given FROM v_fragments)"""
STYLE = ", ".join(f.STYLE)


def _drawings(spark, sf_dir):
    n = F.col("drawing_index")
    return view(spark, sf_dir, "v_fragments").withColumns(
        {
            "fill_opacity": F.when(n % 2 == 0, 1.0).otherwise(0.5), "stroke_opacity": F.when(F.col("stroke_hex").isNotNull(), 1.0), "stroke_width": F.when(F.col("stroke_width") > 1.6, 1.6).otherwise(0.8),
            "layer": F.when(n % 3 == 0, "plan").when(n % 3 == 1, "text"), "ops": F.when(F.col("shape") == "tri", F.array(*[F.lit(o) for o in "lcll"])).otherwise(F.array(F.lit("re"))),
        }
    )


def _given(drawings):
    n = F.col("drawing_index")
    count = F.when(F.col("fill_hex").isNull() | (n % 11 == 0), 0).when(n % 7 == 0, 4).otherwise(1)
    rows = drawings.withColumn("k", F.explode(F.when(count > 0, F.sequence(F.lit(1), count)))).withColumn("feature_id", F.concat_ws("-", F.lit("f"), n.cast("string"), F.col("k").cast("string")))
    return rows.select("collection_id", "drawing_index", "feature_id", (F.col("w") * F.col("h")).alias("area"), (n % 2).alias("holes"))


@query(
    "e4_whole_styles",
    DRAWN + f""", s AS (SELECT *, row_number() OVER (PARTITION BY collection_id, {STYLE} ORDER BY drawing_index) AS nth FROM dr),
    fe AS (SELECT *, row_number() OVER (PARTITION BY collection_id, {STYLE} ORDER BY drawing_index, k) AS place FROM (SELECT *, unnest(range(1, least(given, 3) + 1)) AS k FROM dr)),
    sa AS (SELECT collection_id, {STYLE}, string_agg('f-' || drawing_index || '-' || k, ',' ORDER BY drawing_index, k) AS samples FROM fe WHERE place <= 8 GROUP BY ALL),
    su AS (SELECT collection_id, {STYLE}, min(drawing_index) AS first_drawing, count(*) AS sample_count, CAST(sum(given) AS BIGINT) AS emitted_features, CAST(sum(given * (drawing_index % 2)) AS BIGINT) AS hole_count, CAST(sum(given * CAST(w * h AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS area,
      max(CASE WHEN nth = 1 THEN CASE WHEN is_filled AND given > 0 THEN 1 ELSE 0 END END) = 1 AS is_closed, CASE WHEN count(*) FILTER (is_filled AND given = 0) > 0 THEN 'polygonization_failed_or_degenerate_ring' END AS rejected_reason,
      max(CASE WHEN nth = 1 AND is_filled AND given = 0 THEN 1 ELSE 0 END) = 1 AS late FROM s GROUP BY ALL)
    SELECT su.collection_id, 'vector-def-' || lpad(CAST(row_number() OVER (PARTITION BY su.collection_id ORDER BY first_drawing) AS VARCHAR), 4, '0') AS vector_def_id, {', '.join('su.' + c for c in f.STYLE)}, first_drawing, sample_count, emitted_features, hole_count, area, is_closed, rejected_reason, coalesce(samples, '') AS samples,
    CASE WHEN late THEN 'requires_review' ELSE 'candidate' END AS candidate_status FROM su LEFT JOIN sa ON su.collection_id = sa.collection_id AND {' AND '.join(f'su.{c} IS NOT DISTINCT FROM sa.{c}' for c in f.STYLE)}""",
    FRAGMENTS,
)
def _e4_whole(spark, sf_dir):
    drawings = _drawings(spark, sf_dir)
    out = f.style_definitions(drawings, _given(drawings)).withColumn("samples", F.array_join("sample_feature_ids", ","))
    return out.drop("sample_feature_ids", "classification_status")


#: Fragments of whole styles with a region and a role, both by number.
SORTED = DRAWN + """, so AS (SELECT *, CASE drawing_index % 5 WHEN 0 THEN 'title_block_region' WHEN 1 THEN NULL ELSE 'map_body_region' END AS region,
CASE drawing_index % 4 WHEN 0 THEN 'area_fill_candidate' WHEN 1 THEN 'tessellated_area_fragment' WHEN 2 THEN 'hatch_fragment' END AS role FROM dr)"""
MERGE = ", ".join(f.MERGE_STYLE)


def _sorted(spark, sf_dir):
    n = F.col("drawing_index")
    dash = F.when(F.col("dashes") == "[4 2] 0", "4,2;phase=0").when(F.col("dashes") == "[1 1] 2", "1,1;phase=2")  # null: solid
    region = F.when(n % 5 == 0, "title_block_region").when(n % 5 != 1, "map_body_region")
    role = F.when(n % 4 == 0, "area_fill_candidate").when(n % 4 == 1, "tessellated_area_fragment").when(n % 4 == 2, "hatch_fragment")
    return _drawings(spark, sf_dir).withColumns({"dash_norm": dash, "region": region, "role": role, "area": F.col("w") * F.col("h")})


@query("h3_style_merge_groups", SORTED + f" SELECT collection_id, {MERGE}, count(*) AS n, sum(CAST(w * h AS DECIMAL(18,3))) AS area FROM so WHERE region = 'map_body_region' AND coalesce(role, '') <> 'hatch_fragment' GROUP BY ALL HAVING count(*) >= 2", FRAGMENTS)
def _h3_whole(spark, sf_dir):
    return f.style_merge_groups(_sorted(spark, sf_dir))


@query("h3_merge_skips", SORTED + " SELECT collection_id, CASE WHEN region = 'map_body_region' THEN role ELSE 'non_map_region' END AS reason, count(*) AS n FROM so WHERE region IS DISTINCT FROM 'map_body_region' OR role = 'hatch_fragment' GROUP BY ALL", FRAGMENTS)
def _h3_skips(spark, sf_dir):
    return f.merge_skips(_sorted(spark, sf_dir))


#: Half as many collections, so that they reach 10,000 fragments from sf0.01 on; two of them mostly triangles.
MEASURED = ", v2 AS (SELECT * REPLACE (collection_id % 4 AS collection_id, CASE WHEN drawing_index % CASE WHEN collection_id % 4 < 2 THEN 5 ELSE 2 END = 0 THEN 'rect' ELSE 'tri' END AS shape) FROM v_fragments)" + METRICS.replace("FROM v_fragments", "FROM v2").replace("n >= 1000", "n >= 10000")


@query(
    "h1_tessellation_scores",
    MEASURED + """, b AS (SELECT collection_id, sum(c) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY c DESC, band) AS k FROM (SELECT collection_id, CAST(round_even(cy * 2, 0) AS BIGINT) AS band, count(*) AS c FROM r GROUP BY 1, 2)) WHERE k <= 50 GROUP BY 1),
    s AS (SELECT collection_id, max(c) AS hits FROM (SELECT collection_id, coalesce(fill_hex, 'none') AS f, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
    sc AS (SELECT mm.*, least(1, 0.3::DOUBLE * tiny_height_ratio + 0.25::DOUBLE * tiny_area_ratio + 0.25::DOUBLE * triangular_ratio + 0.1::DOUBLE * s.hits / n + 0.1::DOUBLE * least(1, n / 30000)) AS v,
      least(1, 0.45::DOUBLE * tiny_height_ratio + 0.35::DOUBLE * triangular_ratio + 0.1::DOUBLE * b.hits / n + 0.1::DOUBLE * least(1, n / 4080)) AS t FROM mm JOIN b USING (collection_id) JOIN s USING (collection_id))
    SELECT collection_id, n, detected, round(greatest(tiny_height_ratio, tiny_area_ratio), 6) AS tiny_fragment_ratio, round(v, 6) AS visual, round(t, 6) AS stripe, round(greatest(v, t), 6) AS score, CASE WHEN detected THEN 'merged_polygons' ELSE 'raw_polygons' END AS mode FROM sc""",
    FRAGMENTS,
)
def _h1_scores(spark, sf_dir):
    c = F.col("collection_id")
    shape = F.when(F.col("drawing_index") % F.when(c % 4 < 2, 5).otherwise(2) == 0, "rect").otherwise("tri")
    rows = view(spark, sf_dir, "v_fragments").withColumns({"shape": shape, "collection_id": c % 4})
    out = f.tessellation_scores(d.tessellation_metrics(rows), d.PAGE)
    names = {"tiny_fragment_ratio": "tiny_fragment_ratio", "visual_fragmentation_score": "visual", "stripe_artifact_score": "stripe", "tessellated_fill_score": "score"}
    return out.select("collection_id", "n", "detected", *[F.round(a, 6).alias(b) for a, b in names.items()], F.col("primary_extraction_mode").alias("mode"))
