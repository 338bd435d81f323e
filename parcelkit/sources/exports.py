"""Reading of decoded pages with what is wrong in them, exports of a run's rows, and the layers of a project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import let
from ..operators import intake as i

# Kinds of exports and their formats, and the layers of a project in order.
EXPORTS = {
    "pipeline_traces": "jsonl", "vector_traces": "jsonl", "text_traces": "jsonl", "vector_definitions": "csv", "text_definitions": "csv", "legend_crops": "csv", "legend_items": "csv", "legend_symbols": "csv",
    "classification_proposals": "csv", "structured_errors": "csv", "legend_rows": "csv", "task_stats": "csv", "correction_tasks": "csv", "agent_legend_proposals": "csv", "raw_fragment_debug_sample": "jsonl",
}
LAYERS = {"import": "append", "staging": "replace", "manual": "append", "core": "replace", "api": "replace"}
# End of fixed values.
#: Drawings and spans as decoders hand them over; the named fields must be there.
DRAWING = "collection_id long, page_index int, drawing_index long, fill array<double>, color array<double>, width double, dashes string, fill_opacity double, stroke_opacity double, even_odd boolean, closePath boolean, lineCap int, lineJoin int, layer string, rect struct<x0:double,y0:double,x1:double,y1:double>, items array<struct<op:string,points:array<struct<x:double,y:double>>>>"
SPAN = "collection_id long, page_index int, block int, line int, span int, text string, font string, size double, color long, alpha int, bbox array<double>, dir array<double>"
NEEDED = {DRAWING: ["collection_id", "drawing_index", "rect", "items"], SPAN: ["collection_id", "text", "bbox"]}
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def _read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    kinds = T.StructType.fromDDL(schema)
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_file"), "value").where(F.trim("value") != "")
    told = F.from_json("value", T.StructType([*kinds.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("r", told)
    missing = lambda r: F.filter(F.array(*[F.when(r[c].isNull(), F.lit(c)) for c in NEEDED[schema]]), lambda x: x.isNotNull())
    absent = lambda r: let(missing(r), lambda m: F.when(F.size(m) > 0, F.concat(F.lit("missing: "), F.array_join(m, ", "))))
    reason = let(told, lambda r: F.when(r.isNull() | r["_corrupt"].isNotNull(), "not_of_the_declared_form").otherwise(absent(r)))  # parsed once, also as a filter
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select("source_file", *[F.col("r")[c].alias(c) for c in kinds.names])
    return good, rows.where("reason is not null").select("source_file", "reason", F.col("value").alias("record"))


def read_drawings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(drawings, errors) of the JSON lines under ``path``: DRAWING's columns with source_file, and (source_file, reason, record) of lines that are no such record.

    A line that is no JSON or whose values have other types is not_of_the_declared_form; one without a needed field says which. Other fields are ignored, blank lines skipped.
    """
    return _read(spark, path, DRAWING)


def read_spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spans, errors) as :func:`read_drawings` gives them, with SPAN's columns."""
    return _read(spark, path, SPAN)


def _export_path(folder: str, kind: str) -> str:
    return f"{folder}/{kind}.{EXPORTS[kind]}"


def export_records(tables: dict[str, DataFrame], run: DataFrame, folder: str) -> list[str]:
    """Write each table (by its kind of EXPORTS) with the columns of ``run`` filled in where a row has none, and return the paths.

    ``run``: one row per collection_id with run_id, source_filename and the like. JSON lines keep nested values, with the keys in order and nulls; CSV has them as JSON text. Files lie in a folder
    for each collection (``collection=``), so one of them is exported by itself too; writing again replaces only the collections that come again. An unknown kind is a KeyError, and nothing is written.
    """
    if unknown := [k for k in tables if k not in EXPORTS]:
        raise KeyError(unknown[0])
    paths = []
    for kind, rows in tables.items():
        full = i.export_rows(rows, run)
        flat = EXPORTS[kind] == "csv"
        full = i.flatten_nested(full) if flat else full.select(*[i._sorted(F.col(f.name), f.dataType).alias(f.name) for f in sorted(full.schema.fields, key=lambda f: f.name)])
        out = full.withColumn("collection", F.col("collection_id")).write.partitionBy("collection").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        path = _export_path(folder, kind)
        if flat:
            out.options(**_CSV).csv(path)
        else:
            out.option("ignoreNullFields", "false").json(path)
        paths.append(path)
    return paths


def read_export(spark: SparkSession, folder: str, kind: str, schema: str | None = None) -> DataFrame:
    """The rows of an exported kind as they were written; a KeyError if there is no such kind."""
    path = _export_path(folder, kind)
    reader = spark.read.schema(schema) if schema else spark.read
    return (reader.options(**_CSV).csv(path) if EXPORTS[kind] == "csv" else reader.json(path)).drop("collection")


def read_layer(spark: SparkSession, folder: str, layer: str, schema: str) -> DataFrame:
    """A layer as it stands; empty before its first writing."""
    path = f"{folder}/{layer}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_layers(spark: SparkSession, folder: str, tables: dict[str, DataFrame | Callable], keys: dict[str, list[str]], collections: DataFrame) -> dict[str, DataFrame]:
    """Write a run's layers in the order of LAYERS and return all of them as they then stand.

    ``tables`` holds for each layer its rows, or a function of the layers before it (by name, as written) that gives them; all have collection_id, by which they are stored. ``import`` and ``manual`` only grow:
    rows whose ``keys`` the layer has are not written again, so what stands there is never replaced, and a run that is repeated, or broke off half-way, adds what is missing and no more. The other
    layers are derived, and replaced for the run's ``collections`` (collection_id); those that have no rows any more are emptied, and others stay as they are.
    """
    done: dict[str, DataFrame] = {}
    for layer, mode in LAYERS.items():
        rows = tables[layer](done) if callable(tables[layer]) else tables[layer]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        path = f"{folder}/{layer}"
        if mode == "append":
            known = read_layer(spark, folder, layer, schema).select(*keys[layer])
            own = rows.dropDuplicates(keys[layer])
            matched = [own[k].eqNullSafe(known[k]) for k in keys[layer]]
            own.join(known.hint("shuffle_hash"), matched, "left_anti").write.partitionBy("collection_id").mode("append").parquet(path)
        else:
            rows = rows.join(collections.select("collection_id").distinct().hint("shuffle_hash"), "collection_id", "left_semi").select(*rows.columns)
            rows.write.partitionBy("collection_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
            _empty(spark, path, collections, rows)
        done[layer] = read_layer(spark, folder, layer, schema)
    return done


def _empty(spark: SparkSession, path: str, collections: DataFrame, rows: DataFrame) -> None:
    """Delete the folders of ``collections`` that have no ``rows``; there is one name for each such collection to go through."""
    gone = collections.select("collection_id").distinct().join(rows.select("collection_id").distinct().hint("shuffle_hash"), "collection_id", "left_anti")
    for r in gone.toLocalIterator():
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection_id={r[0]}")
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
