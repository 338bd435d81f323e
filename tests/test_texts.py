"""Literal tests of addresses, text specifications, candidates and evidence totals."""

import hashlib
import json
import urllib.parse

from pyspark.sql import functions as F

from parcelkit.operators import publishing, texts
from parcelkit.plans import publishing as plan

URLS = [
    "https://a.cz/x y.pdf", "HTTP://A.cz/%C4%8D/č/*!~_-.", "http://a.cz", "http://a.cz?q=1 2+3&z=%2B", "https://a.cz/p#frag ment", "https://a.cz/100%/%zz", "https://a.cz/a%252Fb?x=%2525", "  https://a.cz/b?  ", "https://a.cz/?a=b;c,d'(e)", "https://u:p@a.cz:8080/p;v=1?x:y/z?",
]


def expected(url):
    parts = urllib.parse.urlsplit(url.strip())
    path, query = (urllib.parse.quote(urllib.parse.unquote(x), safe=safe) for x, safe in ((parts.path, "/%"), (parts.query, "=&?/%:+")))
    return urllib.parse.urlunsplit((parts.scheme, parts.netloc, path, query, parts.fragment))


def test_addresses_as_the_standard_library_writes_them(spark):
    got = {r.u: r.n for r in spark.createDataFrame([(u,) for u in URLS], "u string").select("u", texts.normalized_url(F.col("u")).alias("n")).collect()}
    well = [u for u in URLS if "%zz" not in u]
    assert {u: got[u] for u in well} == {u: expected(u) for u in well}


def test_registry(spark):
    good, bad = texts.source_registry(spark.createDataFrame([(u,) for u in ["http://a.cz/x y", "http://a.cz/x%20y", " http://a.cz/x y", "ftp://a.cz", None, None, "", "http:a"]], "raw_url string"))
    assert [(r.url, r.times, r.name) for r in good.collect()] == [("http://a.cz/x%20y", 3, hashlib.sha256(b"http://a.cz/x%20y").hexdigest()[:16])]
    assert {(r.raw_url, r.times) for r in bad.collect()} == {("ftp://a.cz", 1), (None, 2), ("", 1), ("http:a", 1)}


def test_fingerprints(spark):
    rows = [(1, "b", None, ["x", "ž"]), (2, None, 2.5, [])]
    got = texts.fingerprint_ids(spark.createDataFrame(rows, "a int, c string, b double, d array<string>"), ["d", "c", "b", "a"]).collect()
    for r, (a, c, b, d) in zip(got, rows, strict=True):
        h = hashlib.sha256(json.dumps({"a": a, "b": b, "c": c, "d": d}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert (r.stable_hash, r.run_id, r.collection_key) == (h, f"run-{h[:12]}", f"collection-{h[12:24]}")


def test_text_details_and_groups(spark):
    spans = spark.createDataFrame([(1, 1, "\tBX c \n", "Deja-BOLD", 0xFF0000), (1, 2, " ", "x", 1), (1, 3, "Bydlení  v domech", None, None), (1, 4, "bydleni v domech", None, None), (1, 5, "nic", "-Oblique", -1), (1, 6, None, "x", 1)], "collection_id int, span_index long, raw_text string, font_name string, color long")
    got = {r.span_index: r for r in texts.text_details(spans).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert (got[1].code, got[1].font_family, got[1].is_bold, got[1].color_hex, got[1].token_count, got[1].label, got[1].legend_score) == ("BX.c", "Deja", True, "#ff0000", 2, None, 0.82)
    assert (got[3].code, got[3].label, got[3].is_bold, got[3].color_hex, got[3].normalized_text) == ("B", "Bydlení  v domech", False, None, "bydleni v domech")
    assert (got[5].font_family, got[5].is_italic, got[5].color_hex, got[5].rejected_reason, got[5].classification_score) == (None, True, "#ffffff", "not_target_scope_text", 0.0)
    groups = {r.first_span: r for r in texts.text_groups(texts.text_details(spans)).collect()}
    assert set(groups) == {1, 3, 5} and (groups[3].sample_count, groups[3].sample_text, groups[3].text_role, groups[5].candidate_status) == (2, "Bydlení  v domech", "classification_or_legend_candidate", "requires_review")


def test_candidates(spark):
    rows = [(1, 5, "ZMEN", "Z", None, "Z1", "#1", True), (1, 3, "ZMEN", "Z", None, "Z2", "#1", True), (1, 9, "ZMEN", "Z", None, "Z1", None, False), (1, 4, None, None, "stav", "", "#1", True)]
    features = spark.createDataFrame(rows, "collection_id int, fid long, layer string, class string, type_text string, text_id string, style_hex string, has_fill boolean")
    got = sorted((r.kind, r.first_fid, r.source_style_key, r.sample_text, r.text_role, r.sample_count, r.proposed_type, r.display_label) for r in publishing.definition_candidates(features, *plan._vocabulary(spark)).collect())
    label = "ZMEN.Z - Zastavitelná plocha"
    assert got == [
        ("text", 3, None, "Z2", "change_label", 1, "NAVRH", f"{label} (Z2)"), ("text", 5, None, "Z1", "change_label", 2, "NAVRH", f"{label} (Z1)"),
        ("vector", 3, "#1", None, None, 2, "NAVRH", f"{label} (Z2)"), ("vector", 4, "#1", None, None, 1, "STAV", None), ("vector", 9, "not_exposed", None, None, 1, "NAVRH", f"{label} (Z1)"),
    ]


def test_evidence_totals(spark):
    rows = spark.createDataFrame([(1, "fill_region", "#ff0000", None, None, 2.0, 2.0, True, "4,2"), (1, "text_anchor", None, None, None, None, None, None, None), (1, "hatch_line", None, "#f0f0f0", 1.9, 9.0, 1.0, False, "4,2")], "collection_id int, evidence string, fill_hex string, stroke_hex string, stroke_width double, w double, h double, is_closed boolean, dashes string")
    r = texts.evidence_totals(rows).head().asDict()
    assert [r[c] for c in ("total_records", "fills", "strokes", "closed_paths", "open_paths", "white_strokes", "red_fills", "thin_lines", "thick_lines", "text_anchors", "hatch_line_candidates")] == [3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert {(h.kind, h.value, h.n) for h in texts.evidence_histograms(rows).collect()} == {("role", "fill_region", 1), ("role", "text_anchor", 1), ("role", "hatch_line", 1), ("dash", "4,2", 2)}
