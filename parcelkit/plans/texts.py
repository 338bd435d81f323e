"""Queries on whole text specifications, the registry of sources and evidence totals, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import texts as t
from .catalogue import CODED, FRAGMENTS, query
from .evidence import EVIDENCE, _evidence
from .views import view

#: Spans with fonts, colours and labels of several words.
STYLED = CODED.replace("FROM v_spans", "FROM (SELECT * REPLACE (CASE WHEN span_index % 9 = 4 THEN '  Smíšené obytné venkovské ' WHEN span_index % 13 = 5 THEN 'plochy  bydlení' ELSE raw_text END AS raw_text, CASE span_index % 5 WHEN 0 THEN 'Arial-BoldMT' WHEN 1 THEN 'Times-Italic' WHEN 2 THEN 'Obliqué' WHEN 3 THEN '-x' END AS font_name), CASE WHEN span_index % 4 > 0 THEN span_index * 7919 END AS color FROM v_spans)") + r""",
tx AS (SELECT *, coalesce(code, CASE WHEN regexp_matches(normalized, '\bsmisene\s+obytne\b') THEN 'S' WHEN regexp_matches(normalized, '\bbydleni\b') THEN 'B' END) AS any_code, regexp_matches(normalized, '\bsmisene\s+obytne\b|\bbydleni\b') AS spelled,
CASE WHEN color IS NOT NULL THEN '#' || lpad(lower(to_hex(color & 16777215)), 6, '0') END AS color_hex, CASE span_index % 5 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Times' WHEN 2 THEN 'Obliqué' END AS font_family FROM c)"""


def _styled(spark, sf_dir):
    n = F.col("span_index")
    rows = view(spark, sf_dir, "v_spans")
    text = F.when(n % 9 == 4, "  Smíšené obytné venkovské ").when(n % 13 == 5, "plochy  bydlení").otherwise(F.col("raw_text"))
    font = F.when(n % 5 == 0, "Arial-BoldMT").when(n % 5 == 1, "Times-Italic").when(n % 5 == 2, "Obliqué").when(n % 5 == 3, "-x")
    return t.text_details(rows.withColumns({"raw_text": text, "font_name": font, "color": F.when(n % 4 > 0, n * 7919)}))


@query(
    "e7_whole_text_specs",
    STYLED + r""" SELECT collection_id, span_index, normalized AS normalized_text, font_family, span_index % 5 = 0 AS is_bold, span_index % 5 IN (1, 2) AS is_italic, color_hex, CAST(length(text) AS INTEGER) AS char_count, CAST(len(string_split_regex(text, '\s+')) AS INTEGER) AS token_count, any_code AS code, CASE WHEN spelled THEN text END AS label,
    CASE WHEN any_code IS NULL THEN 0.0::DOUBLE ELSE 0.82::DOUBLE END AS legend_score, CASE WHEN any_code IS NULL THEN 'not_target_scope_text' END AS rejected_reason FROM tx""",
    ("v_spans",),
)
def _e7_whole(spark, sf_dir):
    return _styled(spark, sf_dir).select("collection_id", "span_index", "normalized_text", "font_family", "is_bold", "is_italic", "color_hex", "char_count", "token_count", "code", "label", "legend_score", "rejected_reason")


@query(
    "e8_whole_text_definitions",
    STYLED + """ SELECT collection_id, normalized AS normalized_text, font_name, color_hex, count(*) AS sample_count, min(span_index) AS first_span, arg_min(text, span_index) AS sample_text, max(any_code) AS code, CASE WHEN max(any_code) IS NULL THEN 'source_text' ELSE 'classification_or_legend_candidate' END AS text_role,
    CASE WHEN max(any_code) IS NULL THEN 'requires_review' ELSE 'candidate' END AS candidate_status FROM tx GROUP BY collection_id, normalized, font_name, color_hex""",
    ("v_spans",),
)
def _e8_whole(spark, sf_dir):
    return t.text_groups(_styled(spark, sf_dir)).drop("label", "font_family")


#: Addresses with spaces, letters beyond ASCII, escapes and fragments, by number.
ADDRESSES = """, ad AS (SELECT source_id, CASE source_id % 6 WHEN 0 THEN ' HTTPS://Host.cz/a b/%C4%8D*~.pdf?q=ě š&x=1+2#top ' WHEN 1 THEN 'ftp' || substr(url, 5) WHEN 2 THEN url || '?n=a b%2F' || CAST(source_id % 50 AS VARCHAR) ELSE url END AS raw_url FROM v_sources),
pa AS (SELECT *, regexp_extract(trim(raw_url), '(?i)^(https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'fragment']) AS p FROM ad),
nu AS (SELECT raw_url, CASE WHEN p.scheme <> '' THEN lower(p.scheme) || '://' || p.host || replace(replace(url_encode(url_decode(p.path)), '%2F', '/'), '%25', '%') || CASE WHEN p.query <> '' THEN '?' || replace(replace(replace(replace(replace(replace(replace(url_encode(url_decode(p.query)), '%3D', '='), '%26', '&'), '%3F', '?'), '%2F', '/'), '%3A', ':'), '%2B', '+'), '%25', '%') ELSE '' END
|| CASE WHEN p.fragment <> '' THEN '#' || p.fragment ELSE '' END END AS url FROM pa)""".replace("\\\\", "\\")


def _addresses(spark, sf_dir):
    n = F.col("source_id")
    raw = F.when(n % 6 == 0, " HTTPS://Host.cz/a b/%C4%8D*~.pdf?q=ě š&x=1+2#top ").when(n % 6 == 1, F.concat(F.lit("ftp"), F.expr("substr(url, 5)"))).when(n % 6 == 2, F.concat("url", F.lit("?n=a b%2F"), (n % 50).cast("string"))).otherwise(F.col("url"))
    return view(spark, sf_dir, "v_sources").select(raw.alias("raw_url"))


@query("a4_registered_sources", ADDRESSES + " SELECT url, count(*) AS times, substr(sha256(url), 1, 16) AS name FROM nu WHERE url IS NOT NULL GROUP BY url", ("v_sources",))
def _a4_registered(spark, sf_dir):
    return t.source_registry(_addresses(spark, sf_dir))[0]


@query("a4_rejected_sources", ADDRESSES + " SELECT raw_url, count(*) AS times, 'unsupported_scheme' AS reason FROM nu WHERE url IS NULL GROUP BY raw_url", ("v_sources",))
def _a4_rejected(spark, sf_dir):
    return t.source_registry(_addresses(spark, sf_dir))[1]


@query("a5_fingerprints", """, k AS (SELECT source_id, sha256('{"content_type":"' || content_type || '","n_chars":' || CASE WHEN source_id % 4 = 0 THEN 'null' ELSE CAST(n_chars AS VARCHAR) END || ',"url":"' || url || '"}') AS h FROM v_sources)
SELECT source_id, h AS stable_hash, 'run-' || substr(h, 1, 12) AS run_id, 'collection-' || substr(h, 13, 12) AS collection_key FROM k""", ("v_sources",))  # fmt: skip
def _a5_fingerprints(spark, sf_dir):
    rows = view(spark, sf_dir, "v_sources").withColumn("n_chars", F.when(F.col("source_id") % 4 != 0, F.col("n_chars")))
    return t.fingerprint_ids(rows, ["url", "n_chars", "content_type"]).select("source_id", "stable_hash", "run_id", "collection_key")


@query(
    "k3_evidence_totals",
    EVIDENCE + """ SELECT collection_id, count(*) AS total_records, count(fill_hex) AS fills, count(stroke_hex) AS strokes, count(*) FILTER (drawing_index % 3 = 0) AS closed_paths, count(*) FILTER (drawing_index % 3 = 1) AS open_paths, count(*) FILTER (ws) AS white_strokes, count(*) FILTER (stroke_hex = '#222222') AS black_strokes,
    count(*) FILTER (fill_hex IN ('#ff0000', '#d9483f')) AS red_fills, count(*) FILTER (stroke_hex IS NOT NULL AND least(w, h) <= 3) AS thin_lines, count(*) FILTER (stroke_width >= 1.8 OR evidence = 'thick_boundary_line') AS thick_lines, count(*) FILTER (evidence = 'dotted_boundary_dot') AS dot_candidates, 0::BIGINT AS text_anchors,
    count(*) FILTER (evidence = 'hatch_line') AS hatch_line_candidates, count(*) FILTER (evidence = 'label_mask') AS label_mask_candidates FROM ev GROUP BY collection_id""",
    FRAGMENTS,
)
def _k3_totals(spark, sf_dir):
    n = F.col("drawing_index") % 3
    return t.evidence_totals(_evidence(spark, sf_dir).withColumn("is_closed", F.when(n == 0, True).when(n == 1, False)))


@query("k3_evidence_histograms", EVIDENCE + " SELECT collection_id, 'role' AS kind, evidence AS value, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT collection_id, 'dash', dashes, count(*) FROM ev WHERE dashes <> '' GROUP BY ALL", FRAGMENTS)
def _k3_histograms(spark, sf_dir):
    return t.evidence_histograms(_evidence(spark, sf_dir))
