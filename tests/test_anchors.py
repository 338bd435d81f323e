"""Anchors, crops and labels on literal rows: nulls, empty texts, ties and missing partners."""

from parcelkit.operators import anchors as a
from parcelkit.operators import evidence as e


def test_anchor_forms(spark):
    texts = ["bx p", "BX-C a", "z51A", "Z-7", "xZ1", "", None, "BXp"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, raw_text string")
    got = {r.k: (r.evidence, r.normalized_label) for r in a.text_anchors(rows).collect()}
    assert [got[k][1] for k in range(8)] == ["BX.p", "BX.c", "Z.51a", "Z.7", None, None, None, "BX.p"]
    assert {got[k][0] for k in (4, 5, 6)} == {"unknown"}


def test_crops_and_errors(spark):
    boxes = [["0", "0", "5", "6"], ["0", "0", "5"], ["0", "0", "x", "6"], ["0", "0", "NaN", "6"], ["5", "0", "5", "6"], ["0", None, "5", "6"], None]
    crops, errors = a.manual_crops(spark.createDataFrame(list(enumerate(boxes)), "k int, box array<string>"))
    assert [(r.k, r.box) for r in crops.collect()] == [(0, [0.0, 0.0, 5.0, 6.0])]
    assert {r.k: r.error.split()[-1] for r in errors.collect()} == {1: "numbers", 2: "numeric", 3: "numeric", 4: "height", 5: "numeric", 6: "numbers"}


def test_labels_of_rows(spark):
    spans = spark.createDataFrame([(1, 2, "dům", 300.0, 100.0, 310.0, 110.0), (1, 1, "Pole a", 300.0, 100.0, 320.0, 110.0), (1, 3, None, 280.0, 104.0, 290.0, 112.0), (2, 1, "les", 300.0, 100.0, 310.0, 110.0)], "collection_id int, span_index int, raw_text string, x0 double, y0 double, x1 double, y1 double")
    rows = spark.createDataFrame([(1, "BI", 95.0, 120.0), (1, "B", 200.0, 220.0)], "collection_id int, code string, top double, bottom double")
    got = {r.code: (r.label, r.lines, r.status) for r in a.legend_labels(spans, rows, (0.0, 0.0, 400.0, 400.0)).collect()}
    assert got == {"BI": ("Pole a dům", 2, "ok"), "B": (None, 0, "agent_proposed")}


def test_evidence_records(spark):
    """Closed by fill or by a rectangle, open by a stroke or a width, neither without any; nulls take their defaults; long numbers keep all digits."""
    kind = "collection_id int, drawing_index long, page_number int, x0 double, y0 double, w double, h double, operations string, fill_hex string, stroke_hex string, stroke_width double, dashes string"
    rows = [
        (1, 1, 2, 0.0, 0.0, 5.0, 5.0, "l", "#d9483f", None, None, None), (1, 2, None, 0.0, 0.0, 5.0, 5.0, "l,re", None, "#123456", 1.23456, "[4 2] 0"),
        (1, 3, None, 0.0, 0.0, 5.0, 5.0, None, None, None, 2.0, ""), (1, 1234567, None, 0.0, None, 5.0, 5.0, "l", "", "", None, None),
    ]
    texts = [(1, 7, None, "BX c", 0.0, 0.0, 1.0, 1.0, "#000000"), (1, 8, 3, None, None, None, None, None, None)]
    spans = a.text_anchors(spark.createDataFrame(texts, "collection_id int, span_index long, page_number int, raw_text string, x0 double, y0 double, x1 double, y1 double, color_hex string"))
    got = {r.evidence_id: r for r in a.evidence_records(e.evidence_index(spark.createDataFrame(rows, kind)), spans).collect()}
    assert {k: (r.geometry_type, r.closed, r.open) for k, r in got.items()} == {
        "draw-000001": ("closed_path", True, False), "draw-000002": ("closed_path", True, False), "draw-000003": ("open_path", False, True),
        "draw-1234567": ("open_path", False, False), "text-000007": ("text", False, False), "text-000008": ("text", False, False),
    }
    assert [(got[k].operation, got[k].dash_pattern, got[k].stroke_width, got[k].page_number) for k in ("draw-000002", "draw-000003")] == [("l,re", "[4 2] 0", 1.2346, 1), ("unknown", "solid", 2.0, 1)]
    assert (got["text-000007"].normalized_label, got["text-000007"].fill_hex, got["text-000008"].evidence, got["text-000008"].page_number) == ("BX.c", "#000000", "unknown", 3)
