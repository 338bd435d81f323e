"""Operators on sources, queues and published rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_STATUSES = ("review_required", "candidate_requires_legend_or_profile_mapping")


def source_inventory(sources: DataFrame, least: int = 1024) -> DataFrame:
    """(source_id, sha256, n_bytes, kind, status) of sources (source_id, url, content_type, body).

    kind is geojson or pdf by content type or ending, else unsupported; a pdf of fewer than ``least`` bytes is suspiciously small. A null body has 0 bytes and no digest.
    """
    url, kind = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("content_type", F.lit("")))
    body = F.col("body").cast("binary")
    n = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    what = F.when(kind.contains("json") | url.endswith(".json") | url.endswith(".geojson"), "geojson").when(kind.contains("pdf") | url.endswith(".pdf") | url.contains("original="), "pdf").otherwise("unsupported")
    status = F.when(what == "unsupported", "unsupported").when((what == "pdf") & (n < least), "suspiciously_small").otherwise("ok")
    return sources.select("source_id", F.sha2(body, 256).alias("sha256"), n.alias("n_bytes"), what.alias("kind"), status.alias("status"))


def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, feature_id, feature_type, properties, geometry_type, coordinates): the features of GeoJSON files; files of any other type, and text that is no JSON, give none."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.from_json("value", "type string, features array<string>").alias("c"))
    rows = texts.where("c.type = 'FeatureCollection'").select("source_file", F.explode("c.features").alias("f"))
    one = F.from_json("f", "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>")
    return rows.select("source_file", one.alias("f")).select("source_file", F.col("f.id").alias("feature_id"), F.col("f.type").alias("feature_type"), "f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of a vocabulary file: an object of objects; lists give one row per element."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("section", "entries"))
    rows = text.select("section", F.explode("entries").alias("key", "value"))
    listed = F.from_json("value", "array<string>")
    return rows.select("section", "key", F.explode(F.when(F.col("value").startswith("["), listed).otherwise(F.array("value"))).alias("value"))


def _sorted(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of structs and the keys of maps in order."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def flatten_nested(rows: DataFrame) -> DataFrame:
    """``rows`` with structs, arrays and maps as JSON text (keys in order, nulls kept), and the columns in order."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    column = lambda f: F.to_json(_sorted(F.col(f.name), f.dataType), {"ignoreNullFields": "false"}) if isinstance(f.dataType, nested) else F.col(f.name)
    return rows.select(*[column(f).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)])


def export_rows(rows: DataFrame, run: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``run`` (one row per collection_id) where their own are missing, null or empty."""
    names = [c for c in run.columns if c != "collection_id"]
    known = run.select("collection_id", *[F.col(c).alias(f"_run_{c}") for c in names])
    out = rows.join(known.hint("shuffle_hash"), "collection_id", "left")
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_run_{c}")) if c in rows.columns else F.col(f"_run_{c}")
    return out.withColumns({c: own(c) for c in names}).drop(*[f"_run_{c}" for c in names])


def to_geojson(features: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """(collection_id, fid, feature): each row as the JSON text of a feature; null properties stay."""
    body = F.struct(F.lit("Feature").alias("type"), F.col("fid").alias("id"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties"))
    return features.select("collection_id", "fid", F.to_json(body, {"ignoreNullFields": "false"}).alias("feature"))


def review_queue(polygons: DataFrame, candidates: DataFrame) -> DataFrame:
    """``polygons`` whose candidate (candidate_id, classification_status) waits for a review; those without a candidate go."""
    waiting = candidates.where(F.col("classification_status").isin(*REVIEW_STATUSES)).select("candidate_id", "classification_status")
    return polygons.join(waiting.hint("shuffle_hash"), "candidate_id")


def promote(features: DataFrame, events: DataFrame) -> DataFrame:
    """The published rows: ``features`` whose target was approved, with the area of the last edit, and the last label beside them.

    ``events``: target_id, ts, event_id, action, area_after, note_json. One pass over the events gives all three. Features without approval go.
    """
    at = F.struct("ts", "event_id")
    last = lambda action, value: F.max_by(F.when(F.col("action") == action, F.col(value)), F.when(F.col("action") == action, at))
    said = events.groupBy("target_id").agg(F.count_if(F.col("action") == "approve").alias("approvals"), last("edit", "area_after").alias("edited"), last("edit", "event_id").alias("manual_edit_id"), last("label", "note_json").alias("label_override"))
    rows = features.join(said.where("approvals > 0").withColumnRenamed("target_id", "fid").hint("shuffle_hash"), "fid")
    return rows.withColumn("area", F.coalesce("edited", "area")).withColumn("review_status", F.lit("approved")).drop("edited", "approvals")


def state_snapshot(events: DataFrame) -> DataFrame:
    """(record_set, target_id, event_id): the latest event of every kind for every target."""
    return events.groupBy(F.col("action").alias("record_set"), "target_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
