"""Queries on page images, legend crops and the diagnosis of streamed pages, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as d
from ..operators import legends as lg
from ..operators import raster
from ..sources.folders import new_folder
from ..streaming import reviews as st
from .catalogue import CODED, FRAGMENTS, ORACLE, query
from .records import CANDIDATES
from .views import view

#: Fragments as pixels: a tile of 16 by 16 holds 256 of them in their order, eight tiles make a row of the region's image.
PIXELS = """, px AS (SELECT collection_id, fill_hex, (drawing_index - 1) // 256 % 8 * 16 + (drawing_index - 1) % 16 AS px, (drawing_index - 1) // 2048 * 16 + (drawing_index - 1) % 256 // 16 AS py FROM v_fragments WHERE collection_id <> 5 OR fill_hex IN ('#86b37f', '#d9483f'))"""


def _tiles(spark, sf_dir):
    k = F.col("drawing_index") - 1
    f = view(spark, sf_dir, "v_fragments").where("collection_id <> 5 or fill_hex in ('#86b37f', '#d9483f')")
    colour = F.coalesce(F.substring("fill_hex", 2, 6), F.lit("7f7f7f"))
    tile = f.groupBy("collection_id", F.floor(k / 256).alias("tile")).agg(F.array_sort(F.collect_list(F.struct((k % 256).alias("p"), colour.alias("c")))).alias("m"))
    row = F.array_join(F.transform("m", lambda e, i: F.concat(F.repeat(F.lit("7f7f7f"), (e["p"] - F.coalesce(F.get("m", i - 1)["p"], F.lit(-1)) - 1).cast("int")), e["c"])), "")
    row = F.rpad(row, 256 * 6, "7f7f7f")  # grey before each pixel that is there, as far as the one before, and after the last
    return tile.select("collection_id", (F.col("tile") % 8 * 16).alias("left"), (F.floor(F.col("tile") / 8) * 16).alias("top"), F.lit(16).alias("width"), F.lit(3).alias("channels"), F.unhex(row).alias("samples"))


def _raster_sql(mode: str, of: str, extra: str) -> str:
    page = lambda corner, f, c: f"round({corner}::DOUBLE + {f}({c}) FILTER ({of}) / 2.0::DOUBLE, 3)"
    return PIXELS + f""" SELECT collection_id, count(*) FILTER (fill_hex = '#ffffff') AS white, count(*) FILTER (fill_hex IN ('#ff0000', '#d9483f')) AS red, count(*) FILTER (fill_hex = '#000000') AS dark,
{page('100.5', 'min', 'px')} AS ex0, {page('50.25', 'min', 'py')} AS ey0, {page('100.5', 'max', 'px')} AS ex1, {page('50.25', 'max', 'py')} AS ey1, {extra} FROM px GROUP BY collection_id"""


def _raster(spark, sf_dir, mode):
    tiles = _tiles(spark, sf_dir)
    regions = tiles.select("collection_id").distinct().withColumns({"x0": F.lit(100.5), "y0": F.lit(50.25), "scale": F.lit(2.0)})
    return raster.raster_evidence(tiles, regions, mode).drop("pixels")


@query("k8_raster_hatches", _raster_sql("hatch", "fill_hex = '#ffffff'", "count(*) FILTER (fill_hex = '#ffffff') > 200 AS detected, CASE WHEN count(*) FILTER (fill_hex = '#ffffff') > 200 THEN 2 ELSE 0 END AS hatch_orientations"), FRAGMENTS)
def _k8_hatches(spark, sf_dir):
    return _raster(spark, sf_dir, "hatch")


@query("k8_raster_dots", _raster_sql("dots", "fill_hex = '#000000'", "count(*) FILTER (fill_hex = '#000000') > 100 AS detected, count(*) FILTER (fill_hex = '#000000') AS dot_candidates"), FRAGMENTS)
def _k8_dots(spark, sf_dir):
    return _raster(spark, sf_dir, "dots")


@query("f13_legend_crops", CANDIDATES + f""", lg AS (SELECT collection_id, bx0, by0, bx1, by1, score FROM sc WHERE score >= 0.45 AND collection_id < 5 QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY score DESC, "order") = 1),
td AS (SELECT collection_id, normalized, font_name, arg_min((span_index, text, code, x0, y0, x1, y1), span_index) AS t FROM c WHERE code IS NOT NULL AND collection_id NOT IN (4, 7) GROUP BY ALL),
tf AS (SELECT collection_id, t[1] AS span_index, t[2] AS text, t[3] AS code, t[4] AS x0, t[5] AS y0, t[6] AS x1, t[7] AS y1 FROM td),
ti AS (SELECT tf.*, score, coalesce((x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (y0 + y1) / 2 BETWEEN by0 AND by1, false) AS inside, row_number() OVER (PARTITION BY tf.collection_id ORDER BY span_index) AS nth FROM tf LEFT JOIN lg ON lg.collection_id = tf.collection_id),
tc AS (SELECT *, CASE WHEN max(inside::INTEGER) OVER (PARTITION BY collection_id) = 1 THEN inside ELSE nth <= 20 END AS cropped FROM ti),
tp AS (SELECT *, sum(cropped::INTEGER) OVER (PARTITION BY collection_id ORDER BY span_index) AS place FROM tc),
sd AS (SELECT collection_id, string_agg(text, ' ' ORDER BY place) FILTER (cropped AND place <= 24) AS extracted, arg_min(code, span_index) FILTER (cropped) AS code, arg_min(text, span_index) FILTER (cropped) AS anchor, CAST(count(DISTINCT code) FILTER (cropped) AS INTEGER) AS codes FROM tp GROUP BY collection_id),
al AS (SELECT DISTINCT collection_id FROM v_spans)
SELECT al.collection_id, 'legend-autocrop-0001' AS crop_id, 'auto' AS source, bx0 AS cx0, by0 AS cy0, bx1 AS cx1, by1 AS cy1, extracted AS extracted_text, code AS matched_code, CAST(NULL AS VARCHAR) AS matched_label, anchor AS anchor_text, coalesce(codes, 0) AS codes, score AS confidence, 'requires_review' AS review_status,
CASE WHEN codes IS NULL THEN '{lg.NO_TEXT}' END AS reason FROM al JOIN lg ON lg.collection_id = al.collection_id LEFT JOIN sd ON sd.collection_id = al.collection_id
UNION ALL SELECT collection_id, printf('legend-text-anchor-%04d', nth), 'text_anchor', x0, y0, x1, y1, text, code, NULL, text, 1, 0.4::DOUBLE, 'requires_review', CASE WHEN score IS NULL THEN '{lg.NO_CROP}' END FROM tp WHERE nth <= 20
UNION ALL SELECT collection_id, 'legend-unavailable-0001', 'unavailable', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0.0::DOUBLE, 'unavailable', '{lg.NO_SOURCE}' FROM al WHERE collection_id NOT IN (SELECT collection_id FROM lg) AND collection_id NOT IN (SELECT collection_id FROM sd)""", ("v_spans",))  # fmt: skip
def _f13(spark, sf_dir):
    """Crops were rendered for some collections only, and two have no named texts, so that all branches occur."""
    spans = view(spark, sf_dir, "v_spans")
    legends = lg.select_legend(lg.legend_candidates(spans)).where("collection_id < 5")
    return lg.legend_crops(d.text_specs(spans).where("collection_id not in (4, 7)"), legends, spans)


@query("t1_stream_diagnosis", ORACLE["c2_diagnosis"])
def _t1_diagnosis(spark, sf_dir):
    """Suppliers' file as a stream of pages; the diagnosis of what has come so far, after the last batch."""
    base = spark.read.parquet(f"{sf_dir}/supplier.parquet").schema
    stream = spark.readStream.schema(base).parquet(f"{sf_dir}/supplier.parque[t]")
    key = F.col("s_suppkey")
    pages = stream.select((key % 8).cast("int").alias("collection_id"), key.cast("int").alias("page_index"), (key * 131 % 2400).cast("int").alias("drawing_count"), (F.col("s_nationkey") % 3).cast("int").alias("image_count"), ((key % 5).cast("int") * 40).alias("text_span_count"))
    folder = new_folder(spark, "diagnosis")
    st.page_diagnosis(pages, view(spark, sf_dir, "v_fragments"), view(spark, sf_dir, "v_spans"), folder).awaitTermination()
    return st.read_diagnosis(spark, folder)
