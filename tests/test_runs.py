"""Metrics without fan-out, steps, checks with both outcomes, counts taken while tables are written."""

from pyspark.sql import functions as F

from parcelkit.operators import runs as r

#: A run that passes all checks.
GOOD = {
    "raw_fragment_count": 60000, "primary_feature_count": 1200, "primary_extraction_mode": "merged_polygons", "tessellated_fill_detected": True, "merge_algorithm": "vector_tessellated_fill_merge_v1", "raw_features_are_debug_only": True,
    "raw_fragment_debug_sample_count": 5, "plan_snapshot_available": 1, "plan_snapshot_url": "s.png", "plan_snapshot_scale_x": 2.0, "legend_crop_image_count": 1, "legend_crop_transform_count": 1, "legend_candidate_count": 3, "legend_candidate_selected_count": 1,
    "legend_candidate_without_evidence_count": 0, "legend_crop_missing_file_count": 0, "manual_legend_crop_fallback_count": 1, "legend_item_count": 7, "legend_symbol_count": 14, "legend_vector_def_count": 14, "paired_item_count": 7, "fabricated_symbol_count": 0,
    "checkbox_to_vector_def_wiring_count": 14, "task_stats_count": 1, "correction_task_count": 5, "method_row_count": 8, "extraction_profile_algorithm": "method_aware_extraction_profile_v8_2", "extraction_export_status": "blocked", "lab_algorithm": "lab",
    "evidence_index_count": 9, "target_case_count": 1, "experiment_candidate_available_count": 2, "fragment_role_count": 4, "trusted_white_or_background_feature_count": 0, "max_spike_score": 0.9, "artifact_requires_review_feature_count": 3,
    "feature_proposal_count": 1200, "garbled_display_label_count": 0, "roi_area": 10.0, "dot_candidate_count": 4, "hatch_candidate_count": 4, "export_blocked_feature_count": 1, "experiment_candidate_exportable_count": 0,
    "experiment_candidate_raw_changed_count": 0, "missing_experiment_file_count": 0,
    "step_names": [s[0] for s in r.PDF_STEPS], "legend_codes": r.CODES, "method_names": r.METHODS, "experiment_ids": r.EXPERIMENTS, "diagnostic_names": r.DIAGNOSTICS, "feature_property_names": r.PROPERTIES, "bad_fids": [*r.TARGET_FIDS, 5],
}


def _metrics(spark, rows):
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    schema = "collection_id long, " + ", ".join(f"{n} {r.LISTS.get(n) or kinds[type(v)]}" for n, v in GOOD.items())
    return spark.createDataFrame([(i, *[row.get(n) for n in GOOD]) for i, row in enumerate(rows)], schema)


def test_every_check_passes_and_fails(spark):
    names = [n for n, _ in [*r.TESSELLATED_CHECKS, *r.TARGET_CHECKS]]
    bad = {n: [] if n in r.LISTS else "other" if isinstance(v, str) else False if isinstance(v, bool) else type(v)(0) for n, v in GOOD.items()}
    bad |= {"raw_fragment_count": 40, "primary_feature_count": 30, "plan_snapshot_url": "", "lab_algorithm": "", "legend_candidate_selected_count": 0, "legend_candidate_count": 1, "method_row_count": 1, "max_spike_score": 0.8}
    bad |= {n: 1 for n in ("legend_candidate_without_evidence_count", "legend_crop_missing_file_count", "fabricated_symbol_count", "trusted_white_or_background_feature_count", "garbled_display_label_count", "experiment_candidate_exportable_count", "experiment_candidate_raw_changed_count", "missing_experiment_file_count")}
    worst = bad | {"primary_feature_count": 0, "legend_candidate_count": 0, "method_row_count": 0, "raw_fragment_count": 0}
    checked = r.acceptance_checks(_metrics(spark, [GOOD, bad, worst, {}]))
    ok = {}
    for row in checked.collect():
        ok.setdefault(row.collection_id, {})[row.check] = row.ok
    assert list(ok[0]) == names and all(ok[0].values()), [n for n, x in ok[0].items() if not x]
    assert {n for n in names if ok[1][n] and ok[2][n] and ok[3][n]} == set()
    told = {x.collection_id: x for x in r.failures(checked).collect()}
    assert told[0].status == "passed" and told[0].failures == [] and told[1].status == "failed" and told[1].failures == sorted(n for n in names if not ok[1][n])


def test_metrics_join_tables_of_different_grain_without_multiplying(spark):
    run = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "collection_id long, filename string")
    drawings = spark.range(100).select((F.col("id") % 2 + 1).alias("collection_id"), "id")
    spans = spark.createDataFrame([(1, "BI"), (1, "RI"), (9, "X")], "collection_id long, code string")
    out = r.run_metrics(run, [(drawings, {"vector_drawing_count": F.count("*")}), (spans, {"text_span_count": F.count("*"), "legend_codes": F.array_sort(F.collect_set("code"))})])
    got = sorted((x.collection_id, x.filename, x.vector_drawing_count, x.text_span_count, x.legend_codes) for x in out.collect())
    assert got == [(1, "a", 50, 2, ["BI", "RI"]), (2, "b", 50, 0, None), (3, None, 0, 0, None)]
    steps = r.pipeline_trace(out, r.GEOJSON_STEPS).collect()
    assert len(steps) == 12 and [s.step_order for s in steps if s.collection_id == 1] == [1, 2, 3, 4] and len(r.PDF_STEPS) == 27


def test_report_labels(spark):
    rows = [{"vector_feature_count": 5}, {"vector_feature_count": 5, "manual_split_required_count": 1}, {"extraction_export_status": "blocked"}, {"classification_status": "needs_raster", "warning": "w"}]
    names = ["vector_feature_count", "manual_split_required_count", "extraction_export_status", "classification_status", "warning"]
    df = spark.createDataFrame([(k, *[x.get(n) for n in names]) for k, x in enumerate(rows)], "collection_id long, vector_feature_count long, manual_split_required_count long, extraction_export_status string, classification_status string, warning string")
    got = {x.collection_id: (x.status, x.completion_label, x.notes) for x in r.corpus_report(df).collect()}
    note = "review-blocked artifacts/manual split candidates remain"
    assert got == {0: ("passed", "passed", None), 1: ("passed", "completed_review_blocked", note), 2: ("diagnostic_only", "diagnostic_only", note), 3: ("needs_raster", "needs_raster", "w")}
    assert len(r.corpus_report(df).columns) == 37


def test_steps_are_counted_while_they_are_written(spark, tmp_path):
    trace = r.RunTrace()
    drawings = trace.step("drawings", spark.range(1000))
    features = trace.step("features", drawings.withColumn("area", F.col("id") % 10), of="drawings", rejected=F.col("area") == 0, warning=F.col("area") > 8)
    features.where("area > 0").write.parquet(str(tmp_path / "f"))
    assert trace.rows() == [("drawings", None, 1000, 0, 0), ("features", 1000, 900, 100, 100)]
    nothing = r.RunTrace()
    nothing.step("none", spark.range(0), rejected=F.col("id") > 1).write.parquet(str(tmp_path / "n"))
    assert nothing.rows() == [("none", None, 0, 0, 0)]
