"""What a run did: metrics of every document, its steps, errors, tasks, report and acceptance.

Everything here is read off one wide row of metrics per document (:func:`run_metrics`), so each table of a run is aggregated once, whatever asks
for its counts. Steps, statistics and checks are tables of names and SQL conditions on those metrics; a metric that a run does not measure counts as 0, or as missing in a condition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Steps of a run (name, algorithm, input, output, rejected, warnings, status; counts and status are conditions on metrics).
PDF_STEPS = [
    ("source_input", "pdf_upload_or_url_v1", "1", "1", "0", "0", "'ok'"),
    ("source_detection", "=detection_algorithm", "1", "1", "0", "detection_warning_count", "'ok'"),
    ("pdf_metadata", "pymupdf_metadata_v1", "1", "page_count", "0", "0", "'ok'"),
    ("plan_page_snapshot", "pymupdf_page_render_snapshot_v1", "1", "cast(plan_snapshot_available > 0 as int)", "0", "0", "if(plan_snapshot_available > 0, 'ok', 'warning')"),
    ("vector_drawings_inventory", "page_get_drawings_v1", "page_count", "vector_drawing_count", "0", "0", "'ok'"),
    ("text_inventory", "page_get_text_dict_v1", "1", "text_spec_count", "0", "0", "'ok'"),
    ("vector_path_polygonization", "=selected_algorithm", "vector_drawing_count", "raw_fragment_count", "geometry_error_count", "0", "'ok'"),
    ("dash_pattern_extraction", "pymupdf_dashes_parse_v2", "vector_drawing_count", "dashed_drawing_count", "0", "0", "'ok'"),
    ("text_spec_extraction", "text_span_spec_v1", "text_span_count", "text_spec_count", "0", "0", "'ok'"),
    ("map_legend_region_separation", "right_panel_text_density_region_v1", "raw_fragment_count", "map_body_feature_count", "0", "0", "'ok'"),
    ("tessellation_detection", "stripe_fragment_detector_v1", "raw_fragment_count", "tessellated_fill_detected", "0", "0", "if(tessellated_fill_detected > 0, 'warning', 'ok')"),
    ("fragment_role_classification", "fragment_role_classification_v1", "raw_fragment_count", "trusted_merge_input_count", "0", "0", "'ok'"),
    ("tessellated_fill_merge", "vector_tessellated_fill_merge_v1", "raw_fragment_count", "primary_feature_count", "0", "merge_error_count", "if(merge_error_count > 0, 'warning', 'ok')"),
    ("visual_quality_gate", "raw_fragment_false_success_gate_v1+visual_artifact_diagnostics_v1", "raw_fragment_count", "primary_feature_count", "0", "artifact_requires_review_feature_count", "if(primary_feature_count < raw_fragment_count or tessellated_fill_detected = 0, 'ok', 'warning')"),
    ("legend_autocrop", "legend_candidate_evidence_ranker_v8_1+autocrop_render_v1", "text_spec_count", "legend_crop_image_count", "0", "legend_crop_unavailable_count", "'ok'"),
    ("legend_row_extraction", "target_code_row_symbol_split_v1+label_quality_v1", "text_spec_count", "legend_row_count", "0", "legend_row_review_count", "'ok'"),
    ("legend_item_to_vector_def_split", "legend_item_two_symbol_vector_def_split_v1", "legend_item_count", "legend_vector_def_count", "0", "missing_expected_symbol_count", "'ok'"),
    ("vector_definition_grouping", "style_path_grouping_v1+legend_vector_def_bridge_v1", "vector_drawing_count", "vector_def_count", "0", "0", "'ok'"),
    ("text_definition_grouping", "normalized_text_grouping_v1", "text_spec_count", "text_def_count", "0", "0", "'ok'"),
    ("semantic_classification", "target_scope_evidence_v1", "vector_def_count", "classification_proposal_count", "0", "0", "'ok'"),
    ("spatial_association", "=association_algorithm", "primary_feature_count", "feature_text_association_count", "0", "0", "'ok'"),
    ("feature_proposal_annotation", "=proposal_algorithm", "primary_feature_count", "feature_proposal_count", "0", "artifact_requires_review_feature_count", "'ok'"),
    ("method_aware_extraction_profile", "method_aware_extraction_profile_v8_2", "raw_fragment_count", "method_row_count", "0", "manual_split_required_count", "if(manual_split_required_count > 0, 'requires_review', 'ok')"),
    ("algorithm_lab_experiments", "=lab_algorithm", "raw_fragment_count", "algorithm_lab_experiment_count", "0", "remaining_blocker_count", "'requires_review'"),
    ("target_scope_filtering", "bydleni_rekreace_smisene_scope_v1", "classification_proposal_count", "inscope_classification_proposal_count", "0", "0", "'ok'"),
    ("manual_legend_crop_fallback", "operator_bbox_fallback_v1", "1", "1", "0", "0", "'requires_review'"),
    ("export_candidate_generation", "jsonl_csv_export_bridge_v1", "1", "14", "0", "0", "'ok'"),
]
GEOJSON_STEPS = [
    ("source_input", "=source_origin", "1", "1", "0", "0", "'ok'"),
    ("source_detection", "=detection_algorithm", "1", "1", "0", "0", "'ok'"),
    ("vector_definition_grouping", "geojson_property_grouping_v1", "feature_count", "vector_def_count", "0", "0", "'ok'"),
    ("semantic_classification", "target_scope_evidence_v1", "vector_def_count", "classification_proposal_count", "0", "0", "'ok'"),
]
#: The summary of a run: name, and the metric where that has another name.
TASK_STATS = {n: m or n for n, m in [
    ("raw_fragments", "raw_fragment_count"), ("primary_features", "primary_feature_count"), ("raw_to_primary_ratio", ""), ("vector_definitions", "vector_def_count"), ("text_definitions", "text_def_count"),
    ("legend_crops", "legend_crop_count"), ("legend_rows", "legend_row_count"), ("legend_items", "legend_item_count"), ("legend_symbols", "legend_symbol_count"), ("legend_vector_definitions", "legend_vector_def_count"),
    ("two_row_vector_def_split_count", "paired_item_count"), ("missing_expected_symbol_count", ""), ("ignored_extra_symbol_count", ""), ("checkbox_to_vector_def_wiring_count", ""), ("plan_snapshot_available", ""),
    ("white_fill_fragment_count", ""), ("white_fill_fragment_area", ""), ("background_mask_candidate_count", ""), ("rectangular_hole_count", ""), ("rectangular_hole_area_ratio", ""),
    ("holes_removed_as_artifacts_count", ""), ("holes_kept_count", ""), ("hole_review_required_count", ""), ("triangular_void_count", ""), ("small_void_count", ""),
    ("void_area_ratio", ""), ("void_removed_as_artifact_count", ""), ("void_kept_count", ""), ("void_requires_review_count", ""), ("max_spike_score", ""),
    ("spike_count", ""), ("spike_fixed_count", ""), ("spike_review_required_count", ""), ("needle_count", ""), ("sliver_component_count", ""),
    ("thin_corridor_count", ""), ("sliver_removed_count", ""), ("thin_corridor_removed_count", ""), ("artifact_requires_review_feature_count", ""), ("hole_cleanup_removed_hole_count", ""),
    ("hole_cleanup_review_required_hole_count", ""), ("manual_split_required_count", ""), ("hatch_candidate_count", ""), ("dotted_boundary_candidate_count", ""), ("export_blocked_feature_count", ""),
    ("experiment_candidate_available_count", ""), ("algorithm_lab_experiment_count", ""), ("structured_errors", "structured_error_count"), ("geometry_errors", "geometry_error_count"), ("requires_review_rows", "legend_row_review_count"),
    ("exportable_after_review_count", ""),
]}
#: The report of a corpus, in order; texts and flags are null where a run has none.
REPORT_TEXTS = ["filename", "path", "source_fingerprint", "source_type", "primary_extraction_mode", "extraction_profile_algorithm", "extraction_export_status", "experiment_best_current_method"]
REPORT = [
    "filename", "path", "source_fingerprint", "source_type", "page_count", "vector_drawing_count", "text_span_count", "vector_feature_count", "raw_fragment_count", "primary_extraction_mode",
    "raw_features_are_debug_only", "tessellated_fill_detected", "merged_group_count", "vector_def_count", "text_def_count", "legend_crop_count", "inscope_classification_proposal_count", "requires_review_count",
    "geometry_error_count", "structured_error_count", "artifact_requires_review_feature_count", "export_blocked_feature_count", "hole_cleanup_removed_hole_count", "hole_cleanup_review_required_hole_count",
    "extraction_profile_algorithm", "manual_split_required_count", "hatch_candidate_count", "dotted_boundary_candidate_count", "extraction_export_status", "algorithm_lab_experiment_count",
    "experiment_candidate_available_count", "experiment_best_current_method", "runtime_ms", "status", "completion_label", "notes",
]
CODES = ["BU", "SX", "BX.c", "BX.p", "BX.r", "RI", "SV"]
METHODS = ["fill_style_polygonization", "hatch_pattern_segmentation", "dotted_boundary_segmentation", "thick_line_boundary_segmentation", "text_anchor_region_assignment", "legend_style_mapping", "raster_assisted_segmentation", "manual_split_required"]
EXPERIMENTS = ["E01", "E02", "E03", "E04", "E05", "E06", "E07", "E08"]
DIAGNOSTICS = ["triangular_void_count", "small_void_count", "void_area_ratio", "void_requires_review_count", "spike_review_required_count", "geometry_cleanup_algorithm", "hole_type_counts", "hole_cleanup_removed_hole_count", "hole_cleanup_review_required_hole_count"]
PROPERTIES = ["raw_CLASS", "proposed_CLASS", "classification_reason", "export_blocking_reason", "artifact_flags", "display_fill_hex", "display_color_source", "source_fill_hex", "geometry_decision", "geometry_decision_reason", "artifact_component_count", "component_count_before", "component_count_after", "hole_cleanup", "hole_type_counts", "manual_split_required"]
TARGET_FIDS = [329, 337, 353]
#: Tasks that every run has: id, algorithm, status.
TASKS = [
    ("kamenice-hlv-raw-fragment-primary-result", "vector_tessellated_fill_merge_v1", "if(tessellated_fill_detected > 0 and raw_features_are_debug_only > 0, 'fixed', 'not_applicable')"),
    ("legend-autocrop-and-row-review", "right_panel_autocrop_render_v1", "'requires_review'"),
    ("visual-artifact-review", "visual_artifact_diagnostics_v1+geometry_artifact_review_flagging_v1", "if(artifact_requires_review_feature_count > 0, 'requires_review', 'not_applicable')"),
    ("semantic-hatch-boundary-split", "method_aware_extraction_profile_v8_2", "if(manual_split_required_count > 0, 'manual_required', 'not_applicable')"),
    ("algorithm-lab-review-candidate", "=lab_algorithm", "if(experiment_candidate_available_count > 0, 'requires_review', 'manual_required')"),
]
# End of fixed values.


def _has_all(wanted: list, column: str) -> str:
    return f"size(array_except(array({', '.join(repr(w) for w in wanted)}), {column})) = 0"


def _step(name: str) -> str:
    return f"array_contains(step_names, '{name}')"


#: Acceptance of a tessellated document: check, condition. Those of lists say which entries are missing.
TESSELLATED_CHECKS = [
    ("raw_fragment_baseline", "raw_fragment_count >= 50000"), ("merged_mode", "primary_extraction_mode = 'merged_polygons'"), ("tessellation_detected", "tessellated_fill_detected > 0"),
    ("merge_step", _step("tessellated_fill_merge")), ("merge_algorithm", "merge_algorithm = 'vector_tessellated_fill_merge_v1'"), ("raw_only_for_debug", "raw_features_are_debug_only > 0"),
    ("primary_features", "primary_feature_count > 0"), ("fewer_than_raw", "primary_feature_count < raw_fragment_count"), ("raw_to_primary_ratio", "raw_fragment_count = 0 or primary_feature_count = 0 or raw_fragment_count / primary_feature_count >= 5"),
    ("debug_sample", "raw_fragment_debug_sample_count > 0"), ("plan_snapshot", "plan_snapshot_available > 0"), ("plan_snapshot_url", "plan_snapshot_url <> ''"), ("plan_snapshot_transform", "plan_snapshot_scale_x <> 0"),
    ("legend_crop_image", "legend_crop_image_count > 0"), ("legend_crop_transform", "legend_crop_transform_count > 0"), ("legend_candidates", "legend_candidate_count > 0"), ("legend_candidate_selected", "legend_candidate_count = 0 or legend_candidate_selected_count > 0"),
    ("legend_candidate_evidence", "legend_candidate_without_evidence_count = 0"), ("legend_crop_files", "legend_crop_missing_file_count = 0"), ("manual_crop_fallback", "manual_legend_crop_fallback_count > 0"),
    ("legend_items", "legend_item_count > 0"), ("legend_symbols", "legend_symbol_count > 0"), ("legend_vector_definitions", "legend_vector_def_count > 0"), ("legend_split_step", _step("legend_item_to_vector_def_split")),
    ("target_codes", _has_all(CODES, "legend_codes")), ("paired_items", "paired_item_count > 0"), ("no_made_up_symbols", "fabricated_symbol_count = 0"), ("wiring", "checkbox_to_vector_def_wiring_count > 0"),
    ("task_stats", "task_stats_count > 0"), ("correction_tasks", "correction_task_count > 0"), ("artifact_diagnostics", "size(diagnostic_names) > 0"), ("extraction_profile", "method_row_count > 0"),
    ("extraction_profile_algorithm", "method_row_count = 0 or extraction_profile_algorithm = 'method_aware_extraction_profile_v8_2'"), ("methods", _has_all(METHODS, "method_names")),
    ("export_blocked", "method_row_count = 0 or extraction_export_status = 'blocked'"), ("algorithm_lab", "lab_algorithm <> ''"), ("experiments", _has_all(EXPERIMENTS, "experiment_ids")), ("evidence_index", "evidence_index_count > 0"),
    ("target_case", "target_case_count > 0"), ("experiment_candidates", "experiment_candidate_available_count > 0"), ("fragment_roles", "fragment_role_count > 0"), ("fragment_role_step", _step("fragment_role_classification")),
    ("proposal_step", _step("feature_proposal_annotation")), ("no_trusted_white", "trusted_white_or_background_feature_count = 0"), ("spikes_are_flagged", "max_spike_score < 0.75 or artifact_requires_review_feature_count > 0"),
    ("diagnostic_names", _has_all(DIAGNOSTICS, "diagnostic_names")), ("feature_proposals", "feature_proposal_count > 0"), ("feature_properties", _has_all(PROPERTIES, "feature_property_names")), ("labels_readable", "garbled_display_label_count = 0"),
]
#: Acceptance of the target case.
TARGET_CHECKS = [
    ("target_roi", "roi_area > 0"), ("target_fids", _has_all(TARGET_FIDS, "bad_fids")), ("target_experiments", _has_all(EXPERIMENTS, "experiment_ids")), ("target_evidence_index", "evidence_index_count > 0"),
    ("dot_candidates", "dot_candidate_count > 0"), ("hatch_candidates", "hatch_candidate_count > 0"), ("target_export_blocked", "extraction_export_status = 'blocked'"), ("blocked_features", "export_blocked_feature_count > 0"),
    ("candidates_not_exportable", "experiment_candidate_exportable_count = 0"), ("candidates_keep_raw", "experiment_candidate_raw_changed_count = 0"), ("target_candidates", "experiment_candidate_available_count > 0"), ("target_files", "missing_experiment_file_count = 0"),
]
LISTS = {"step_names": "array<string>", "legend_codes": "array<string>", "method_names": "array<string>", "experiment_ids": "array<string>", "diagnostic_names": "array<string>", "feature_property_names": "array<string>", "bad_fids": "array<int>"}
TEXTS = {*REPORT_TEXTS, "merge_algorithm", "plan_snapshot_url", "selected_algorithm", "detection_algorithm", "association_algorithm", "proposal_algorithm", "lab_algorithm", "source_origin", "classification_status", "warning"}


def run_metrics(run: DataFrame, measured: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row per collection_id of ``run`` (with its other columns) and every metric: ``measured`` holds tables and the aggregates to take of them.

    Each table is aggregated once, before anything is shuffled; the small results are put together by one more aggregate, so no join multiplies
    rows. Numbers that a collection lacks are 0; texts and lists stay null. A metric may come from one table only.
    """
    parts = [table.groupBy("collection_id").agg(*[c.alias(n) for n, c in measures.items()]) for table, measures in measured]
    own = run.select("collection_id", *[c for c in run.columns if c != "collection_id"])
    every = own
    for part in parts:
        every = every.unionByName(part, allowMissingColumns=True)
    known = own.select("collection_id").distinct()
    out = every.groupBy("collection_id").agg(*[F.max(c).alias(c) for c in every.columns if c != "collection_id"]).join(known.hint("shuffle_hash"), "collection_id", "left_semi")
    return out.na.fill(0)


def _completed(metrics: DataFrame, names: set[str]) -> DataFrame:
    """``metrics`` with all ``names``: numbers 0, texts null, lists empty where they are missing; flags as numbers."""
    kinds = dict(metrics.dtypes)
    more = {}
    for n in names:
        if n in LISTS:
            more[n] = F.coalesce(F.col(n), F.array().cast(LISTS[n])) if n in kinds else F.array().cast(LISTS[n])
        elif n not in kinds:
            more[n] = F.lit(None).cast("string") if n in TEXTS else F.lit(0)
        elif kinds[n] == "boolean":
            more[n] = F.coalesce(F.col(n), F.lit(False)).cast("int")
    return metrics.withColumns(more)


def _words(texts: list[str]) -> set[str]:
    """The metrics that conditions name."""
    known = {"cast", "as", "int", "if", "or", "and", "array_contains", "array_except", "array", "size"}
    return {w for t in texts for w in re.findall(r"[a-z][a-z_0-9]*", re.sub(r"'[^']*'", "", t)) if w not in known}


def pipeline_trace(metrics: DataFrame, steps: list[tuple] = PDF_STEPS) -> DataFrame:
    """One row per collection and step: step_order, step_name, algorithm, input, output, rejected and warning counts, and status.

    An algorithm written as ``=name`` is what the metric of that name says.
    """
    rows = _completed(metrics, _words([x for s in steps for x in s[2:]]) | {s[1][1:] for s in steps if s[1].startswith("=")})
    long = lambda x: F.expr(x).cast("long")
    told = F.array(*[
        F.struct(
            F.lit(k).alias("step_order"), F.lit(name).alias("step_name"), (F.col(algorithm[1:]).cast("string") if algorithm.startswith("=") else F.lit(algorithm)).alias("algorithm"), long(a).alias("input_count"),
            long(b).alias("output_count"), long(r).alias("rejected_count"), long(w).alias("warning_count"), F.expr(status).alias("status"),
        )
        for k, (name, algorithm, a, b, r, w, status) in enumerate(steps, 1)
    ])
    return rows.select("collection_id", F.explode(told).alias("s")).select("collection_id", "s.*")


class RunTrace:
    """Counts of a run's steps taken while its tables are made: no table is read again to count it."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str | None, Observation]] = []

    def step(self, name: str, rows: DataFrame, of: str | None = None, rejected: Column | None = None, warning: Column | None = None) -> DataFrame:
        """``rows`` as they are; once they are written, step ``name`` knows how many there were, and how many of them were rejected or have a warning. ``of``: the step that it takes its rows from."""
        seen = Observation(name)
        self.steps.append((name, of, seen))
        flag = lambda c: F.count_if(F.lit(False) if c is None else F.coalesce(c, F.lit(False)))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), flag(rejected).alias("rejected"), flag(warning).alias("warning"))

    def rows(self) -> list[tuple[str, int | None, int, int, int]]:
        """(step, input, output, rejected, warning), once all steps have been written; input is what the step before put out."""
        found = {name: seen.get for name, _, seen in self.steps}
        out = {name: x["rows"] - x["rejected"] for name, x in found.items()}
        return [(name, out.get(of), out[name], found[name]["rejected"], found[name]["warning"]) for name, of, _ in self.steps]


def task_stats(metrics: DataFrame) -> DataFrame:
    """One row per collection with the numbers of TASK_STATS; those that a run does not measure are 0."""
    rows = _completed(metrics, set(TASK_STATS.values()))
    ratio = F.round(F.col("raw_fragment_count") / F.greatest(F.col("primary_feature_count"), F.lit(1)), 3)
    return rows.select("collection_id", *[(ratio if n == "raw_to_primary_ratio" else F.col(m)).alias(n) for n, m in TASK_STATS.items()])


def correction_tasks(metrics: DataFrame, missing_symbols: DataFrame | None = None) -> DataFrame:
    """(collection_id, task_id, algorithm, status): TASKS for each collection, and those of ``missing_symbols`` (the same columns) of the legend."""
    rows = _completed(metrics, _words([t[2] for t in TASKS]) | {"lab_algorithm"})
    told = F.array(*[F.struct(F.lit(i).alias("task_id"), (F.col(a[1:]) if a.startswith("=") else F.lit(a)).alias("algorithm"), F.expr(s).alias("status")) for i, a, s in TASKS])
    out = rows.select("collection_id", F.explode(told).alias("t")).select("collection_id", "t.*")
    return out if missing_symbols is None else out.unionByName(missing_symbols.select("collection_id", "task_id", "algorithm", "status"))


def structured_errors(metrics: DataFrame, found: list[DataFrame] | None = None) -> DataFrame:
    """(collection_id, step, algorithm, severity, error_code, message, affected_id, recovery_action, retryable).

    A collection whose algorithm gives no trusted polygons has an error of its own; ``found``: rows that operators set aside, with collection_id, step, error_code and message, and any of the
    other columns. Severity is then warning and recovery requires_review unless they say otherwise.
    """
    rows = _completed(metrics, {"selected_algorithm"}).where("selected_algorithm <> 'vector_fill_style_polygon_v1'")
    text = lambda x: F.lit(x).cast("string")
    out = rows.select(
        "collection_id", text("vector_extraction").alias("step"), F.col("selected_algorithm").alias("algorithm"), text("warning").alias("severity"), text("algorithm_routed_pending_or_diagnostic").alias("error_code"),
        F.concat(F.lit("selected algorithm "), "selected_algorithm", F.lit(" did not emit trusted vector polygons")).alias("message"), text(None).alias("affected_id"), text("review diagnostics or implement routed algorithm profile").alias("recovery_action"), F.lit(False).alias("retryable"),
    )
    default = {"algorithm": text(None), "severity": text("warning"), "affected_id": text(None), "recovery_action": text("requires_review"), "retryable": F.lit(False)}
    for more in found or []:
        full = more.withColumns({n: c for n, c in default.items() if n not in more.columns})
        out = out.unionByName(full.select(*[F.col(c).cast(k) for c, k in out.dtypes]))
    return out


def corpus_report(metrics: DataFrame) -> DataFrame:
    """One row per collection with the columns of REPORT. A run with features has passed; its label says if exports wait for a review. Without features the run's own classification_status counts."""
    rows = _completed(metrics, {*REPORT, "classification_status", "warning"} - {"status", "completion_label", "notes"})
    blocked = (F.col("export_blocked_feature_count") > 0) | (F.col("manual_split_required_count") > 0) | F.coalesce(F.col("extraction_export_status") == "blocked", F.lit(False))
    rows = rows.withColumn("status", F.when(F.col("vector_feature_count") > 0, "passed").otherwise(F.coalesce("classification_status", F.lit("diagnostic_only"))))
    rows = rows.withColumn("completion_label", F.when((F.col("status") == "passed") & blocked, "completed_review_blocked").otherwise(F.col("status")))
    rows = rows.withColumn("notes", F.coalesce("warning", F.when(blocked, "review-blocked artifacts/manual split candidates remain")))
    return rows.select("collection_id", *REPORT)


def acceptance_checks(metrics: DataFrame, checks: list[tuple[str, str]] | None = None) -> DataFrame:
    """(collection_id, check, ok) for each collection and rule, in one pass over the metrics; a condition that meets a missing value has failed.

    ``checks``: names and conditions, by default TESSELLATED_CHECKS and TARGET_CHECKS.
    """
    checks = [*TESSELLATED_CHECKS, *TARGET_CHECKS] if checks is None else checks
    rows = _completed(metrics, _words([c for _, c in checks]))
    told = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.expr(c), F.lit(False)).alias("ok")) for n, c in checks])
    return rows.select("collection_id", F.explode(told).alias("c")).select("collection_id", "c.*")


def failures(checked: DataFrame) -> DataFrame:
    """(collection_id, status, failures): failed with the names of the checks that failed, or passed."""
    return checked.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check")))).alias("failures")).select("collection_id", F.when(F.size("failures") == 0, "passed").otherwise("failed").alias("status"), "failures")
