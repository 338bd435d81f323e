"""Where a page has its legend, and what its rows say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import documents as d

# Names of the codes, words that legends contain.
CODE_NAMES = {
    "B": "BYDLENÍ", "BI": "BYDLENÍ INDIVIDUÁLNÍ", "BV": "BYDLENÍ VENKOVSKÉ", "BH": "BYDLENÍ HROMADNÉ", "BU": "BYDLENÍ VŠEOBECNÉ",
    "BX.c": "BYDLENÍ JINÉ - ČISTÉ", "BX.p": "BYDLENÍ JINÉ - PŘÍMĚSTSKÉ", "BX.r": "BYDLENÍ JINÉ - REKREAČNÍ",
    "R": "REKREACE", "RI": "REKREACE INDIVIDUÁLNÍ", "RX": "REKREACE JINÁ",
    "S": "SMÍŠENÉ OBYTNÉ", "SO": "SMÍŠENÉ OBYTNÉ OBECNÉ", "SV": "SMÍŠENÉ OBYTNÉ VENKOVSKÉ", "SC": "SMÍŠENÉ OBYTNÉ CENTRÁLNÍ", "SX": "SMÍŠENÉ OBYTNÉ JINÉ",
}
KEYWORDS = ["legenda", "ploch", "stav", "návrh", "navrh", "stabil"]
# End of fixed values.
THRESHOLD = 0.45


def label_quality(text: Column, code: Column) -> Column:
    """(display, status, confidence) of a label: ok, proposed from the code's name where it is empty or garbled, else unreadable."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bad = F.regexp_count(t, F.lit(r"[%<>/\\\"^~{}\[\]]|\p{C}")) / F.greatest(F.length(t), F.lit(1))
    garbled = (F.regexp_count(t, F.lit(r"\p{L}")) < 3) | (bad >= 0.18)
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in CODE_NAMES.items() for x in pair]), code)
    row = lambda show, status, sure: F.struct(show.alias("display"), F.lit(status).alias("status"), F.lit(sure).alias("confidence"))
    return F.when(~garbled, row(F.regexp_replace(t, r"\s+", " "), "ok", 0.82)).when(name.isNotNull(), row(name, "agent_proposed", 0.55)).otherwise(row(F.lit("label unreadable - review"), "manual_required", 0.0))


def legend_candidates(spans: DataFrame, page: tuple[float, float] = d.PAGE) -> DataFrame:
    """Up to four boxes per collection with strategy, score and rejected_reason, from texts with a box (x0, y0, x1, y1).

    Codes at the left edge, all codes, the right panel (or codes on the right), words of legends. The score adds .035 for each
    different code inside the box and .015 for each such word, eight at most, to the strategy's own; below .45 it is rejected.
    Extents are aggregates by collection; texts then meet the few boxes of their collection.
    """
    wide, high = page
    t = d.text_specs(spans)
    low = F.lower("raw_text")
    t = t.withColumn("word", F.col("y0").between(high * 0.18, high * 0.94) & F.greatest(*[low.contains(w).cast("int") for w in KEYWORDS]).cast("boolean"))
    has, margin = F.col("code").isNotNull(), F.col("x0") <= wide * 0.16
    right = (F.col("x0") >= wide * 0.84) & F.col("y0").between(high * 0.48, high * 0.9)
    groups = {"left": has & margin & F.col("y0").between(high * 0.34, high * 0.84), "all": has, "right": right, "right_codes": has & (F.col("x0") >= wide * 0.7), "word": F.col("word")}
    ends = lambda c: F.struct(F.count_if(c).alias("n"), *[f(F.when(c, F.col(x))).alias(x) for f, x in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    own = t.groupBy("collection_id").agg(*[ends(c).alias(n) for n, c in groups.items()], F.count_distinct(F.when(groups["left"], F.col("code"))).alias("left_codes"))
    near = t.where(margin).select("collection_id", "x1", "y0").join(own.select("collection_id", F.col("left.y0").alias("top"), F.col("left.y1").alias("end")), "collection_id")
    head = F.min(F.when(F.col("y0").between(F.greatest(F.lit(0.0), F.col("top") - 180), F.col("top")), F.col("y0")))
    near = near.groupBy("collection_id").agg(head.alias("head"), F.max(F.when(F.col("y0").between(F.col("top") - 80, F.col("end") + 80), F.col("x1"))).alias("label_end"))
    rows = own.join(near, "collection_id", "left")

    def box(order: int, name: Column, base: Column, b: Column, pads: tuple, when: Column, top: Column | None = None, end: Column | None = None) -> Column:
        x0, y0 = F.greatest(F.lit(0.0), b["x0"] - pads[0]), F.greatest(F.lit(0.0), (b["y0"] if top is None else top) - pads[1])
        x1, y1 = F.least(F.lit(wide), (b["x1"] if end is None else end) + pads[2]), F.least(F.lit(high), b["y1"] + pads[3])
        return F.when(when, F.struct(F.lit(order).alias("order"), name.alias("strategy"), base.alias("base"), b["n"].alias("anchors"), *[F.round(v, 3).alias(k) for k, v in (("bx0", x0), ("by0", y0), ("bx1", x1), ("by1", y1))]))

    left, every, panel, codes, words = (F.col(n) for n in groups)
    dense = panel["n"] >= 6
    found = F.array(
        box(0, F.lit("target_left_legend_code_cluster_v1"), F.lit(0.68), left, (85, 55, 90, 75), (left["n"] >= 8) & (F.col("left_codes") >= 5), F.coalesce("head", left["y0"]), F.greatest("label_end", left["x1"])),
        box(1, F.lit("target_code_global_cluster_v1"), F.lit(0.46), every, (110, 90, 160, 95), every["n"] >= 6),
        F.when(dense, box(2, F.lit("right_panel_text_density_v1"), F.lit(0.58), panel, (160, 120, 80, 90), dense)).otherwise(box(2, F.lit("target_code_right_cluster_v1"), F.lit(0.40), codes, (160, 120, 80, 90), codes["n"] > 0)),
        box(3, F.lit("legend_keyword_density_v1"), F.lit(0.38), words, (120, 80, 160, 90), words["n"] >= 4),
    )
    boxes = rows.select("collection_id", F.explode(F.filter(found, lambda b: b.isNotNull())).alias("b")).select("collection_id", "b.*")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    texts = t.where(has | F.col("word")).select("collection_id", "code", "word", cx.alias("cx"), cy.alias("cy"))
    inside = F.col("cx").between(F.col("bx0"), F.col("bx1")) & F.col("cy").between(F.col("by0"), F.col("by1"))
    key = ["collection_id", *[c for c in boxes.columns if c != "collection_id"]]
    seen = texts.join(boxes.hint("shuffle_hash"), "collection_id").groupBy(*key).agg(F.count_distinct(F.when(inside, F.col("code"))).alias("codes"), F.count_if(inside & F.col("word")).alias("words"))
    seen = seen.withColumn("words", F.when(F.col("order") == 3, F.col("anchors")).otherwise(F.col("words")))
    empty = (F.col("bx1") <= F.col("bx0")) | (F.col("by1") <= F.col("by0"))
    score = F.least(F.lit(1.0), F.col("base") + F.least("codes", F.lit(8)) * 0.035 + F.least("words", F.lit(8)) * 0.015)
    out = seen.withColumn("score", F.when(empty, 0.0).otherwise(F.round(score, 4)))
    return out.withColumn("rejected_reason", F.when(empty, "invalid_or_empty_bbox").when(score < THRESHOLD, "low_confidence_evidence")).drop("base")


def select_legend(candidates: DataFrame) -> DataFrame:
    """The best candidate of each collection that is not rejected, the earlier strategy on ties, with its confidence band."""
    best = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("score"), "order"))
    rows = candidates.where("rejected_reason is null").withColumn("_n", best).where("_n = 1").drop("_n")
    return rows.withColumn("band", F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.55, "medium").when(F.col("score") > 0, "low").otherwise("n/a"))


def legend_symbols(spans: DataFrame, legend: tuple[float, float, float, float]) -> DataFrame:
    """(collection_id, code, span_index, role, class_type, sx0, sy0, sx1, sy1): the swatches of each row (code) inside ``legend``.

    The role goes by the distance from its left side: below 130 stav_stabil, below 230 navrh, else ignored_extra. A role counts once in a
    row, by x0, then span_index; extras all stay.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    rows = d.text_specs(spans).where("code is not null").where(cx.between(legend[0], legend[2]) & cy.between(legend[1], legend[3]))
    away = cx - legend[0]
    rows = rows.withColumn("role", F.when(away < 130, "stav_stabil").when(away < 230, "navrh").otherwise("ignored_extra"))
    nth = F.row_number().over(Window.partitionBy("collection_id", "code", "role").orderBy("x0", "span_index"))
    half = F.when(F.col("role") == "navrh", 45.0).otherwise(43.0)
    rows = rows.withColumn("_n", nth).where("_n = 1 or role = 'ignored_extra'")
    cut = [F.greatest(F.lit(legend[0]), cx - half), F.greatest(F.lit(legend[1]), cy - 19.0), F.least(F.lit(legend[2]), cx + half), F.least(F.lit(legend[3]), cy + 21.0)]
    kind = F.when(F.col("role") == "stav_stabil", 1).when(F.col("role") == "navrh", 2)
    return rows.select("collection_id", "code", "span_index", "role", kind.alias("class_type"), *[F.round(v, 3).alias(k) for k, v in zip(("sx0", "sy0", "sx1", "sy1"), cut, strict=True)])


def legend_items(symbols: DataFrame) -> DataFrame:
    """One row per legend row: symbols found, extras, the roles that are missing, status and confidence."""
    rows = symbols.groupBy("collection_id", "code").agg(F.count_if(F.col("role") == "stav_stabil").alias("stav"), F.count_if(F.col("role") == "navrh").alias("navrh"), F.count_if(F.col("role") == "ignored_extra").alias("extras"))
    missing = F.concat_ws(",", F.when(F.col("stav") == 0, "stav_stabil"), F.when(F.col("navrh") == 0, "navrh"))
    rows = rows.withColumn("missing_roles", missing)
    whole = F.col("missing_roles") == ""
    return rows.withColumn("status", F.when(whole, "two_symbols_detected").otherwise("missing_expected_symbol_requires_review")).withColumn("confidence", F.when(whole, 0.78).otherwise(0.52)).drop("stav", "navrh")


# What a crop without texts and a text without a crop are said to lack.
NO_TEXT = "legend autocrop rendered, but text inventory found no target code/label candidate inside the PDF text layer"
NO_SOURCE = "legend crop detector not implemented for this source; text inventory found no target legend/code candidate"
NO_CROP = "legend text candidate exists, but no rendered legend autocrop was available"
# End of fixed values.
CROP_TEXTS, ANCHORS = 24, 20


def legend_crops(specs: DataFrame, legends: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection_id, crop_id, source, cx0, cy0, cx1, cy1, extracted_text, matched_code, matched_label, anchor_text, codes, confidence, review_status, reason) for each of ``collections``.

    ``specs``: text_specs; each text and font counts once, by its first span, if it has a code or a label. ``legends``: rows of select_legend whose
    crop was rendered. A legend gives one auto crop with what its texts say (those inside it, or the first ANCHORS without any inside; at most CROP_TEXTS are spelled out), the first ANCHORS texts
    one text_anchor crop each; a collection with neither has one unavailable row.
    """
    key = ["collection_id", "normalized", "font_name"]
    named = specs.where("code is not null or label is not null")
    first = named.groupBy(*key).agg(F.min_by(F.struct("span_index", "text", "code", "label", "x0", "y0", "x1", "y1"), "span_index").alias("t")).select("collection_id", "t.*")
    boxes = legends.select("collection_id", "bx0", "by0", "bx1", "by1", F.col("score").alias("legend_score"))
    rows = first.join(boxes.hint("shuffle_hash"), "collection_id", "left")
    inside = F.coalesce(((F.col("x0") + F.col("x1")) / 2).between(F.col("bx0"), F.col("bx1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("by0"), F.col("by1")), F.lit(False))
    rows = rows.withColumn("inside", inside)
    by = Window.partitionBy("collection_id")
    rows = rows.withColumn("nth", F.row_number().over(by.orderBy("span_index"))).withColumn("any_inside", F.max("inside").over(by))
    rows = rows.withColumn("cropped", F.when(F.col("any_inside"), F.col("inside")).otherwise(F.col("nth") <= ANCHORS))
    rows = rows.withColumn("place", F.when(F.col("cropped"), F.sum(F.col("cropped").cast("int")).over(by.orderBy("span_index").rowsBetween(Window.unboundedPreceding, 0))))
    at = lambda c: F.min_by(F.when(F.col("cropped"), F.col(c)), F.when(F.col("cropped") & F.col(c).isNotNull(), F.col("span_index")))
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= CROP_TEXTS, F.struct("place", "text")))), lambda x: x["text"]), " ")
    said = rows.groupBy("collection_id").agg(spelled.alias("extracted_text"), at("code").alias("matched_code"), at("label").alias("matched_label"), at("text").alias("anchor_text"), F.count_distinct(F.when(F.col("cropped"), F.col("code"))).alias("codes"))
    every = collections.select("collection_id").distinct().join(boxes.hint("shuffle_hash"), "collection_id", "left").join(said.hint("shuffle_hash"), "collection_id", "left")
    legend, texts = F.col("legend_score").isNotNull(), F.col("codes").isNotNull()
    auto = every.where(legend).select(
        "collection_id", F.lit("legend-autocrop-0001").alias("crop_id"), F.lit("auto").alias("source"), *[F.col(f"b{c}").alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")], F.nullif(F.trim("extracted_text"), F.lit("")).alias("extracted_text"), "matched_code", "matched_label",
        "anchor_text", F.coalesce("codes", F.lit(0)).cast("int").alias("codes"), F.col("legend_score").alias("confidence"), F.lit("requires_review").alias("review_status"), F.when(~texts, NO_TEXT).alias("reason"),
    )
    anchors = rows.where(F.col("nth") <= ANCHORS).select(
        "collection_id", F.format_string("legend-text-anchor-%04d", "nth").alias("crop_id"), F.lit("text_anchor").alias("source"), *[F.col(c).alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")], F.col("text").alias("extracted_text"), F.col("code").alias("matched_code"),
        F.col("label").alias("matched_label"), F.col("text").alias("anchor_text"), F.col("code").isNotNull().cast("int").alias("codes"), F.lit(0.4).alias("confidence"), F.lit("requires_review").alias("review_status"), F.when(F.col("legend_score").isNull(), NO_CROP).alias("reason"),
    )
    anchors = anchors.join(collections.select("collection_id").distinct().hint("shuffle_hash"), "collection_id", "left_semi")
    blank = lambda kind: F.lit(None).cast(kind)
    neither = every.where(~legend & ~texts).select(
        "collection_id", F.lit("legend-unavailable-0001").alias("crop_id"), F.lit("unavailable").alias("source"), *[blank("double").alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")], *[blank("string").alias(c) for c in ("extracted_text", "matched_code", "matched_label", "anchor_text")],
        F.lit(0).alias("codes"), F.lit(0.0).alias("confidence"), F.lit("unavailable").alias("review_status"), F.lit(NO_SOURCE).alias("reason"),
    )
    return auto.unionByName(anchors).unionByName(neither)
