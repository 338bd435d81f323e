"""Style definitions of drawings, merge groups by whole style, and scores of a tessellation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import styles as s
from ..sources.folders import written

#: The parts of a style; path_ops are the counts of its path operators as text.
STYLE = ["fill_hex", "stroke_hex", "fill_opacity", "stroke_opacity", "stroke_width", "dash_norm", "layer", "path_ops", "is_filled", "is_stroked"]
#: What a merge keeps together.
MERGE_STYLE = ["fill_hex", "fill_opacity", "stroke_hex", "stroke_opacity", "stroke_width", "dash_norm", "layer"]
AREA = "decimal(18,3)"
MAP_BODY = "map_body_region"
TRUSTED = ("area_fill_candidate", "tessellated_area_fragment")
REJECTED = "polygonization_failed_or_degenerate_ring"


def operator_counts(ops: Column) -> Column:
    """``ops`` (an array of path operators) as text: each operator with its count, in order."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ops)), lambda o: F.concat(o, F.lit("="), F.size(F.filter(ops, lambda x: x == o)).cast("string"))), ",")


def emitted(features: DataFrame, most: int = 3) -> DataFrame:
    """(collection_id, drawing_index, n, area, holes, ids): what each drawing gave, with its first ``most`` features by feature_id. A drawing's features stand in one task: they came from one record."""
    nth = F.row_number().over(Window.partitionBy("collection_id", "drawing_index").orderBy("feature_id"))
    ids = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("feature_id"))))
    return features.withColumn("_n", nth).groupBy("collection_id", "drawing_index").agg(F.count("*").alias("n"), F.sum(F.col("area").cast(AREA)).alias("area"), F.sum("holes").alias("holes"), ids.alias("ids"))


def style_definitions(drawings: DataFrame, features: DataFrame, most: int = 8) -> DataFrame:
    """One row per whole style (STYLE) of a collection, numbered by first drawing.

    ``drawings``: collection_id, drawing_index, the parts of STYLE but path_ops and the flags, dashes instead of dash_norm, ops (array<string>).
    ``features``: collection_id, drawing_index, feature_id, area, holes; those without drawing_index count nowhere. Null parts of a style are equal.
    Numbers are sums over the style's drawings; first_drawing, is_closed and status are those of its first drawing; rejected_reason is there if any
    filled drawing gave no feature; sample_feature_ids are the first ``most`` features, at most three of a drawing.
    Drawings meet their features once: that table is written, for sums and for samples. Samples come from a ranking that stops at ``most`` drawings before its shuffle, so a style that a third of all drawings has stays small.
    """
    d = drawings.withColumns({"dash_norm": s.dash(F.col("dashes"))["norm"], "path_ops": operator_counts(F.coalesce("ops", F.array().cast("array<string>")))})
    d = d.withColumns({"is_filled": F.col("fill_hex").isNotNull(), "is_stroked": F.col("stroke_hex").isNotNull()})
    given = emitted(features.where("drawing_index is not null"))
    rows = d.select("collection_id", "drawing_index", *STYLE).join(given.hint("merge"), ["collection_id", "drawing_index"], "left").withColumn("rejected", F.when(F.col("is_filled") & F.col("n").isNull(), F.lit(REJECTED)))
    rows = written(rows.withColumn("style_key", F.to_json(F.struct(*STYLE), {"ignoreNullFields": "false"})), "styles")  # the key is no part of the join
    key = ["collection_id", "style_key"]
    first = F.min_by(F.struct(*STYLE, (F.col("is_filled") & F.col("n").isNotNull()).alias("is_closed"), F.col("rejected").alias("first_rejected")), "drawing_index").alias("f")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.groupBy(*key).agg(
        first, F.min("drawing_index").alias("first_drawing"), F.count("*").alias("sample_count"), zero("n").alias("emitted_features"), zero("holes").alias("hole_count"),
        zero("area").cast(AREA).alias("area"), F.max("rejected").alias("rejected_reason"),
    )
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("drawing_index"))
    near = rows.where("n is not null").select(*key, "drawing_index", "ids").withColumn("_n", nth).where(F.col("_n") <= most)
    picked = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("drawing_index", "ids"))), lambda x: x["ids"])), 1, most)
    samples = near.groupBy(*key).agg(picked.alias("sample_feature_ids"))
    out = sums.join(samples.hint("shuffle_hash"), key, "left")
    number = F.row_number().over(Window.partitionBy("collection_id").orderBy("first_drawing"))
    review = F.col("f.first_rejected").isNotNull()
    return out.select(
        "collection_id", F.concat(F.lit("vector-def-"), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), "0")).alias("vector_def_id"), *[F.col(f"f.{c}").alias(c) for c in STYLE],
        "first_drawing", "sample_count", "emitted_features", "hole_count", "area", F.col("f.is_closed").alias("is_closed"), "rejected_reason",
        F.coalesce("sample_feature_ids", F.array().cast("array<string>")).alias("sample_feature_ids"),
        F.when(review, "requires_review").otherwise("candidate_requires_legend_or_profile_mapping").alias("classification_status"), F.when(review, "requires_review").otherwise("candidate").alias("candidate_status"),
    )


def style_merge_groups(fragments: DataFrame, least: int = 2) -> DataFrame:
    """Fragments of the map body that may be merged, by whole style (MERGE_STYLE): n and area of each group of at least ``least``. A missing role is trusted, a missing dash is solid."""
    f = fragments.withColumn("dash_norm", F.coalesce("dash_norm", F.lit("solid"))).where((F.col("region") == MAP_BODY) & (F.col("role").isNull() | F.col("role").isin(*TRUSTED)))
    return f.groupBy("collection_id", *MERGE_STYLE).agg(F.count("*").alias("n"), F.sum(F.col("area").cast(AREA)).alias("area")).where(F.col("n") >= least)


def merge_skips(fragments: DataFrame) -> DataFrame:
    """(collection_id, reason, n): fragments outside the map body (non_map_region; a missing region too), and those inside by their untrusted role."""
    away = F.coalesce(F.col("region") != MAP_BODY, F.lit(True))
    reason = F.when(away, "non_map_region").when(~F.col("role").isin(*TRUSTED), F.col("role"))
    return fragments.groupBy("collection_id", reason.alias("reason")).agg(F.count("*").alias("n")).where("reason is not null")


def tessellation_scores(metrics: DataFrame, page: tuple[float, float]) -> DataFrame:
    """``metrics`` (of tessellation_metrics) with both weighted scores, the larger one of them, and the mode of extraction."""
    n = F.col("n")
    tiny, tri = F.col("tiny_height_ratio"), F.col("triangular_ratio")
    dense, bands = F.col("style_hits") / n, F.col("band_hits") / n
    one = lambda c: F.least(F.lit(1.0), c)
    return (
        metrics.withColumn("tiny_fragment_ratio", F.greatest("tiny_height_ratio", "tiny_area_ratio"))
        .withColumn("visual_fragmentation_score", one(0.3 * tiny + 0.25 * F.col("tiny_area_ratio") + 0.25 * tri + 0.1 * dense + 0.1 * one(n / 30_000)))
        .withColumn("stripe_artifact_score", one(0.45 * tiny + 0.35 * tri + 0.1 * bands + 0.1 * one(n / max(page[0] * page[1] / 500, 1.0))))
        .withColumn("tessellated_fill_score", F.greatest("visual_fragmentation_score", "stripe_artifact_score"))
        .withColumn("primary_extraction_mode", F.when(F.col("detected"), "merged_polygons").otherwise("raw_polygons"))
    )
