"""Queries on readers, exports, layers and folded texts, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import texts as tx
from ..operators import documents as d
from ..operators import intake as i
from ..sources import exports as ex
from ..sources.folders import new_folder
from .catalogue import CODED, FRAGMENTS, query
from .views import view

SPANS = ("v_spans",)


@query("a2_read_drawings", """, n AS (SELECT collection_id, CASE WHEN drawing_index % 97 = 0 THEN 'not_of_the_declared_form' WHEN drawing_index % 101 = 0 THEN 'missing: rect, items' END AS reason, CAST(w AS DECIMAL(18,3)) AS w FROM v_fragments)
SELECT CASE WHEN reason IS NULL THEN collection_id ELSE -1 END AS collection_id, reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN w END) AS width FROM n GROUP BY 1, 2""", FRAGMENTS)  # fmt: skip
def _a2(spark, sf_dir):
    """Fragments as JSON lines, some of them cut off and some without their geometry."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    rect = F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    items = F.array(F.struct(F.lit("re").alias("op"), F.array(g.point(x, y), g.point(x + w, y + h)).alias("points")))
    short = F.to_json(F.struct("collection_id", "drawing_index"))
    whole = F.to_json(F.struct("collection_id", "drawing_index", w.alias("width"), rect.alias("rect"), items.alias("items")))
    n, folder = F.col("drawing_index"), new_folder(spark, "drawings")
    view(spark, sf_dir, "v_fragments").select(F.when(n % 97 == 0, F.substring(whole, 1, 40)).when(n % 101 == 0, short).otherwise(whole).alias("value")).write.text(folder)
    rows, errors = ex.read_drawings(spark, folder)
    good = rows.groupBy("collection_id").agg(F.count("*").alias("n"), F.sum(F.col("width").cast("decimal(18,3)")).alias("width"))
    bad = errors.groupBy("reason").agg(F.count("*").alias("n"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True).select(F.coalesce(F.col("collection_id"), F.lit(-1)).cast("int").alias("collection_id"), "reason", "n", "width")


@query("a6_exports", CODED + """, x AS (SELECT collection_id, 'text_definitions' AS kind, CAST(count(*) AS VARCHAR) AS n, string_agg(DISTINCT '[' || normalized || ']', '' ORDER BY '[' || normalized || ']') AS texts FROM (SELECT DISTINCT collection_id, normalized, font_name FROM c) GROUP BY collection_id
UNION ALL SELECT collection_id, 'text_traces', CAST(count(*) AS VARCHAR), string_agg(DISTINCT '[' || raw_text || ']', '' ORDER BY '[' || raw_text || ']') FROM v_spans GROUP BY collection_id)
SELECT collection_id, kind, CAST(n AS BIGINT) AS n, 'run-' || collection_id AS run_id, md5(texts) AS texts FROM x""", SPANS)  # fmt: skip
def _a6_exports(spark, sf_dir):
    """Two kinds written as CSV and as JSON lines, and read back from their files."""
    spans = view(spark, sf_dir, "v_spans")
    run = spans.select("collection_id").distinct().select("collection_id", F.concat(F.lit("run-"), "collection_id").alias("run_id"))
    folder, name = new_folder(spark, "exports"), {"text_definitions": "normalized", "text_traces": "raw_text"}
    box = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    ex.export_records({"text_definitions": d.text_definitions(d.text_specs(spans)), "text_traces": spans.select("collection_id", "span_index", "raw_text", box)}, run, folder)
    out = None
    for kind, text in name.items():
        rows = ex.read_export(spark, folder, kind).groupBy(F.col("collection_id").cast("int").alias("collection_id"), F.lit(kind).alias("kind")).agg(
            F.count("*").alias("n"), F.min("run_id").alias("run_id"), F.md5(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("["), text, F.lit("]")))), "")).alias("texts"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a10_layers", """, ap AS (SELECT target_id, arg_max(area_after, (ts, event_id)) FILTER (action = 'edit') AS edited FROM v_review_events GROUP BY target_id HAVING count(*) FILTER (action = 'approve') > 0),
st AS (SELECT DISTINCT * FROM v_features WHERE class IS NOT NULL), co AS (SELECT st.collection_id, coalesce(edited, area) AS area FROM st JOIN ap ON fid = target_id)
SELECT 'import' AS layer, collection_id, count(*) AS n, CAST(sum(CAST(area AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS area FROM v_features GROUP BY collection_id UNION ALL SELECT 'staging', collection_id, count(*), CAST(sum(CAST(area AS DECIMAL(18,4))) AS DECIMAL(28,4)) FROM st GROUP BY collection_id
UNION ALL SELECT 'manual', collection_id, count(*), CAST(sum(CAST(area_after AS DECIMAL(18,4))) AS DECIMAL(28,4)) FROM v_review_events GROUP BY collection_id UNION ALL SELECT 'core', collection_id, count(*), CAST(sum(CAST(area AS DECIMAL(18,4))) AS DECIMAL(28,4)) FROM co GROUP BY collection_id
UNION ALL SELECT 'api', collection_id, count(*), NULL FROM co GROUP BY collection_id""", ("v_features", "v_review_events"))  # fmt: skip
def _a10(spark, sf_dir):
    """The layers after three runs: half of the documents, all of them, and all of them again."""
    features, events, folder = view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_review_events"), new_folder(spark, "layers")

    def tables(half):
        return {
            "import": features.where("collection_id % 2 = 0") if half else features, "staging": lambda done: done["import"].where("class is not null"), "manual": events,
            "core": lambda done: i.promote(done["staging"], done["manual"]).select("collection_id", "fid", "area", "manual_edit_id", "review_status"), "api": lambda done: i.to_geojson(done["core"], {"FID": F.col("fid")}),
        }

    done = {}
    for half in (True, False, False):
        rows = tables(half)
        done = ex.write_layers(spark, folder, rows, {"import": ["collection_id", "fid"], "manual": ["event_id"]}, rows["import"])
    out, area = None, {"manual": "area_after", "api": None}
    for layer, rows in done.items():
        of = area.get(layer, "area")
        total = F.sum(F.col(of).cast("decimal(18,4)")) if of else F.lit(None).cast("decimal(28,4)")
        counted = rows.groupBy("collection_id").agg(F.count("*").alias("n"), total.alias("area")).select(F.lit(layer).alias("layer"), "collection_id", "n", "area")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("e9_normalized_text", r"""SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS chars FROM (SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss'), '\s+', ' ', 'g')) AS t FROM documents)""")
def _e9(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.normalized_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars"))
