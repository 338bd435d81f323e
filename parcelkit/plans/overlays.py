"""Queries on unions and residuals of polygon layers, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import dissolve
from .catalogue import AREA, query
from .views import view

KEYS = ["collection_id", "fill_hex"]
#: Boxes that overlap tiles and each other: two units to the right for every other one, two to eight wide, some left out; in SQL their cells of 2 by 2.
BOXES = """, b AS (SELECT DISTINCT collection_id, fill_hex, CAST(x0 / 2 AS INTEGER) + drawing_index % 2 + i AS cx, CAST(y0 / 2 AS INTEGER) + j AS cy
FROM (SELECT *, unnest(range(0, 2 + drawing_index % 3)) AS i FROM v_tiles WHERE drawing_index % 5 <> 0), (SELECT unnest(range(0, 2)) AS j))"""


def _box(x, y, w, h):
    return F.array(F.array(g.point(x, y), g.point(x + w, y), g.point(x + w, y + h), g.point(x, y + h), g.point(x, y))).alias("rings")


def _tiles(spark, sf_dir):
    return view(spark, sf_dir, "v_tiles").select(*KEYS, _box(F.col("x0"), F.col("y0"), F.lit(4.0), F.lit(4.0)))


def _boxes(spark, sf_dir):
    n = F.col("drawing_index")
    return view(spark, sf_dir, "v_tiles").where(n % 5 != 0).select(*KEYS, _box(F.col("x0") + 2.0 * (n % 2), F.col("y0"), 4.0 + 2.0 * (n % 3), F.lit(4.0)))


def _border(rings="rings"):
    return F.aggregate(F.transform(rings, g.ring_perimeter), F.lit(0.0), lambda s, x: s + x)


@query("h4_dissolve_overlaps", BOXES + """, p AS (SELECT collection_id, fill_hex, count(*) FILTER (r) + count(*) FILTER (u) AS pairs FROM (SELECT *, coalesce(lead(cx) OVER (PARTITION BY collection_id, fill_hex, cy ORDER BY cx) = cx + 1, false) AS r,
coalesce(lead(cy) OVER (PARTITION BY collection_id, fill_hex, cx ORDER BY cy) = cy + 1, false) AS u FROM b) GROUP BY ALL), n AS (SELECT collection_id, fill_hex, count(*) AS cells FROM b GROUP BY ALL)
SELECT n.collection_id, n.fill_hex, CAST(cells * 4 AS DECIMAL(18,3)) AS area, CAST(cells * 8 - pairs * 4 AS DECIMAL(18,3)) AS perimeter FROM n JOIN p ON p.collection_id = n.collection_id AND p.fill_hex IS NOT DISTINCT FROM n.fill_hex""", ("v_tiles",))  # fmt: skip
def _h4_overlaps(spark, sf_dir):
    rows = dissolve.dissolve(_boxes(spark, sf_dir), KEYS, least_area=0.0)
    return rows.groupBy(*KEYS).agg(F.sum(F.col("area").cast(AREA)).cast(AREA).alias("area"), F.sum(_border().cast(AREA)).cast(AREA).alias("perimeter"))


RESIDUALS = BOXES + """, a AS (SELECT DISTINCT collection_id, fill_hex, CAST(x0 / 2 AS INTEGER) + i AS cx, CAST(y0 / 2 AS INTEGER) + j AS cy FROM v_tiles, (SELECT unnest(range(0, 2)) AS i), (SELECT unnest(range(0, 2)) AS j)),
m AS (SELECT 'missing' AS kind, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'extra', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"""


@query("m6_residuals", RESIDUALS + " SELECT collection_id, fill_hex, kind, CAST(count(*) * 4 AS DECIMAL(18,3)) AS area FROM m GROUP BY ALL", ("v_tiles",))
def _m6(spark, sf_dir):
    rows = dissolve.residual_areas(_tiles(spark, sf_dir), _boxes(spark, sf_dir), KEYS)
    return rows.select(*KEYS, "kind", F.round("area", 3).cast(AREA).alias("area"))


@query("m6_residual_polygons", RESIDUALS + " SELECT collection_id, fill_hex, kind, CAST(count(*) * 4 AS DECIMAL(18,3)) AS area FROM m GROUP BY ALL", ("v_tiles",))
def _m6_polygons(spark, sf_dir):
    """The same areas from the polygons themselves, holes taken off."""
    rows = dissolve.residuals(_tiles(spark, sf_dir), _boxes(spark, sf_dir), KEYS)
    return rows.groupBy(*KEYS, "kind").agg(F.sum(g.polygon_area(F.col("rings")).cast(AREA)).cast(AREA).alias("area"))


#: Tiles as fragments: every other document is a tessellation, every seventh tile no trusted one.
FRAGMENTS_SQL = """, fr AS (SELECT collection_id, fill_hex, x0, y0, drawing_index, collection_id % 2 = 0 AS detected, drawing_index % 7 <> 0 AS trusted FROM v_tiles),
gr AS (SELECT collection_id, fill_hex, count(*) AS fragments, count(DISTINCT (x0, y0)) AS tiles FROM fr WHERE detected AND trusted GROUP BY ALL HAVING count(*) >= 2)"""


def _tile_fragments(spark, sf_dir):
    n = F.col("drawing_index")
    role = F.when(n % 7 == 0, "text_mask_fragment").otherwise("tessellated_area_fragment")
    tiles = view(spark, sf_dir, "v_tiles").select(*KEYS, "drawing_index", role.alias("role"), F.lit("map_body_region").alias("region"), F.lit(16.0).alias("area"), _box(F.col("x0"), F.col("y0"), F.lit(4.0), F.lit(4.0)))
    return tiles, tiles.select("collection_id").distinct().withColumn("detected", F.col("collection_id") % 2 == 0)


@query("h5_merged_features", FRAGMENTS_SQL + """ SELECT collection_id, 'merged_polygons' AS mode, fill_hex, fragments, CAST(fragments * 16 AS DECIMAL(18,3)) AS raw_area, CAST(tiles * 16 AS DECIMAL(18,3)) AS area FROM gr
UNION ALL SELECT collection_id, 'raw_fragments', fill_hex, count(*), CAST(count(*) * 16 AS DECIMAL(18,3)), CAST(count(*) * 16 AS DECIMAL(18,3)) FROM fr WHERE NOT detected GROUP BY ALL""", ("v_tiles",))  # fmt: skip
def _h5_merged(spark, sf_dir):
    rows = dissolve.merged_features(*_tile_fragments(spark, sf_dir), ["fill_hex"])
    merged = F.col("mode") == "merged_polygons"
    count = lambda c: F.when(F.max(merged), F.max(c)).otherwise(F.sum(c))  # noqa: E731  a merged group's numbers stand in each of its components
    return rows.groupBy("collection_id", "mode", "fill_hex").agg(count("fragments").cast("long").alias("fragments"), count("raw_area").cast(AREA).alias("raw_area"), F.sum(F.col("area").cast(AREA)).cast(AREA).alias("area"))
