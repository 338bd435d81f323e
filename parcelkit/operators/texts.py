"""Whole specifications of texts, the registry of sources, and the summary of an evidence index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import styles as s
from ..functions.texts import fold_text, normalized_text
from .documents import target_label

CANDIDATE, SOURCE = "classification_or_legend_candidate", "source_text"


def text_details(spans: DataFrame) -> DataFrame:
    """``spans`` (raw_text, font_name, color as a packed integer) with all that a text's specification has; texts blank after trimming go.

    Adds text, normalized_text, font_family (up to the first hyphen, null if empty), is_bold, is_italic, color_hex, char_count, token_count,
    code (of the text, else of the label it spells out), label, legend_score (.82 with a code), classification_score (.9) and rejected_reason.
    """
    t = spans.withColumn("text", F.regexp_replace("raw_text", r"^\s+|\s+$", "")).where("text <> ''").withColumn("normalized_text", normalized_text(F.col("text")))
    font = fold_text(F.col("font_name"))
    own, spelled = s.target_code(F.col("text")), target_label(F.col("normalized_text"))
    t = t.withColumns({"_own": own, "_spelled": spelled, "_font": font})
    code = F.coalesce("_own", "_spelled")
    hit = code.isNotNull()
    return t.withColumns(
        {
            "font_family": F.nullif(F.substring_index("font_name", "-", 1), F.lit("")), "is_bold": F.col("_font").contains("bold"), "is_italic": F.col("_font").contains("italic") | F.col("_font").contains("oblique"),
            "color_hex": F.when(F.col("color").isNotNull(), F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("color").cast("long").bitwiseAND(0xFFFFFF))), 6, "0"))), "char_count": F.length("text"), "token_count": F.size(F.split("text", r"\s+")),
            "code": code, "label": F.when(F.col("_spelled").isNotNull(), F.col("text")), "legend_score": F.when(hit, 0.82).otherwise(0.0), "classification_score": F.when(hit, 0.9).otherwise(0.0), "rejected_reason": F.when(~hit, "not_target_scope_text"),
        }
    ).drop("_own", "_spelled", "_font")


def text_groups(details: DataFrame) -> DataFrame:
    """One row per (normalized_text, font_name, color_hex) of a collection: count, first text and its span, role and status; null fonts and colours are equal. ``details``: of text_details, with span_index."""
    first = F.min_by(F.struct("text", "code", "label", "font_family", "legend_score"), "span_index").alias("f")
    rows = details.groupBy("collection_id", "normalized_text", "font_name", "color_hex").agg(F.count("*").alias("sample_count"), F.min("span_index").alias("first_span"), first)
    hit = F.col("f.code").isNotNull()
    return rows.select(
        "collection_id", "normalized_text", "font_name", "color_hex", "sample_count", "first_span", F.col("f.text").alias("sample_text"), "f.code", "f.label", "f.font_family",
        F.when(hit, CANDIDATE).otherwise(SOURCE).alias("text_role"), F.when(hit, "candidate").otherwise("requires_review").alias("candidate_status"),
    )


def _quoted(part: Column, safe: str) -> Column:
    """``part`` decoded and percent-encoded again; the characters of ``safe`` stay. What cannot be decoded is encoded as it is."""
    raw = F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)
    out = F.url_encode(raw)
    for form, plain in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), *[(f"%{ord(c):02X}", c) for c in safe if c != "%"], *([("%25", "%")] if "%" in safe else [])]:
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def normalized_url(raw: Column) -> Column:
    """An http or https address with its path and query percent-encoded once; null for any other scheme, and without //."""
    url = F.trim(raw)
    part = lambda k: F.regexp_extract(url, r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    query, fragment = _quoted(part(4), "=&?/%:+"), part(5)
    whole = F.concat(F.lower(part(1)), F.lit("://"), part(2), _quoted(part(3), "/%"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(part(1) != "", whole)


def source_registry(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registered, rejected) of ``sources`` (raw_url): (url, times, name), one row per normalized address, name the first 16 hex digits of its sha256; and (raw_url, times, reason) of those that are no web addresses, null too."""
    counted = sources.groupBy("raw_url").agg(F.count("*").alias("times")).withColumn("url", normalized_url(F.col("raw_url")))
    good = counted.where("url is not null").groupBy("url").agg(F.sum("times").alias("times")).withColumn("name", F.substring(F.sha2("url", 256), 1, 16))
    return good, counted.where("url is null").select("raw_url", "times", F.lit("unsupported_scheme").alias("reason"))


def fingerprint_ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with stable_hash (sha256 of the compact JSON of ``columns`` in order of their names, nulls kept), run_id from its first 12 digits and collection_key from the next 12."""
    h = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn("stable_hash", h).withColumn("run_id", F.concat(F.lit("run-"), F.substring("stable_hash", 1, 12))).withColumn("collection_key", F.concat(F.lit("collection-"), F.substring("stable_hash", 13, 12)))


def evidence_totals(records: DataFrame) -> DataFrame:
    """One row per collection with the 13 counts of an evidence index: ``records`` with evidence, fill_hex, stroke_hex, stroke_width, w, h, is_closed (null for texts)."""
    role = lambda r: F.col("evidence") == r
    counts = {
        "total_records": F.lit(True), "fills": F.col("fill_hex").isNotNull(), "strokes": F.col("stroke_hex").isNotNull(), "closed_paths": F.col("is_closed"), "open_paths": ~F.col("is_closed"),
        "white_strokes": s.near_white(F.col("stroke_hex"), 235, 24), "black_strokes": s.near_black(F.col("stroke_hex"), 45, 28), "red_fills": s.red_fill(F.col("fill_hex")),
        "thin_lines": F.col("stroke_hex").isNotNull() & (F.least("w", "h") <= 3.0), "thick_lines": (F.coalesce("stroke_width", F.lit(0.0)) >= 1.8) | role("thick_boundary_line"),
        "dot_candidates": role("dotted_boundary_dot"), "text_anchors": role("text_anchor"), "hatch_line_candidates": role("hatch_line"), "label_mask_candidates": role("label_mask"),
    }
    return records.groupBy("collection_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])


def evidence_histograms(records: DataFrame) -> DataFrame:
    """(collection_id, kind, value, n): how often each role and each dash pattern occurs, in one pass over ``records`` (evidence, dashes). Records without a pattern count in no dash."""
    pairs = F.explode(F.filter(F.array(F.struct(F.lit("role").alias("kind"), F.coalesce("evidence", F.lit("unknown")).alias("value")), F.struct(F.lit("dash").alias("kind"), F.nullif(F.col("dashes"), F.lit("")).alias("value"))), lambda x: x["value"].isNotNull()))
    small = records.groupBy("collection_id", "evidence", "dashes").agg(F.count("*").alias("n"))
    return small.select("collection_id", "n", pairs.alias("p")).groupBy("collection_id", "p.kind", "p.value").agg(F.sum("n").alias("n"))
