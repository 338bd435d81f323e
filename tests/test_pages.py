"""Tiles counted over several tasks, streamed pages after a restart, crops by texts and labels."""

import numpy as np
import pytest

from parcelkit.operators import documents as d
from parcelkit.operators import evidence as e
from parcelkit.operators import legends as lg
from parcelkit.operators import raster
from parcelkit.streaming import reviews as st


@pytest.mark.parametrize("mode", ["hatch", "dots"])
def test_raster_evidence_equals_a_whole_image(spark, mode):
    r = np.random.default_rng(1)
    images = {k: r.choice([0, 40, 46, 130, 180, 231, 232, 255], size=(60, 84, 4)).astype(np.uint8) for k in (1, 2)} | {3: np.full((60, 84, 4), 128, np.uint8)}
    images[2][:20] = 128
    tiles = [(k, x, y, min(20, 84 - x), 4, bytearray(im[y : y + 16, x : x + 20].tobytes())) for k, im in images.items() for y in range(0, 60, 16) for x in range(0, 84, 20)]
    df = spark.createDataFrame(tiles, "collection_id long, left int, top int, width int, channels int, samples binary").repartition(7)
    regions = spark.createDataFrame([(k, 10.0, 20.5, 2.0) for k in (1, 2, 3, 4)], "collection_id long, x0 double, y0 double, scale double")
    got = {x.collection_id: x for x in raster.raster_evidence(df, regions, mode).collect()}
    for k, im in images.items():
        rgb = im[:, :, :3].astype(int)
        white, dark, red = (rgb.min(2) >= 232), (rgb.max(2) <= 45), (rgb[:, :, 0] >= 170) & (rgb[:, :, 1] <= 120) & (rgb[:, :, 2] <= 120)
        y, x = np.nonzero(white if mode == "hatch" else dark)
        box = [round(10 + x.min() / 2, 3), round(20.5 + y.min() / 2, 3), round(10 + x.max() / 2, 3), round(20.5 + y.max() / 2, 3)] if len(x) else [None] * 4
        g = got[k]
        assert (g.pixels, g.white, g.red, g.dark) == (60 * 84, white.sum(), red.sum(), dark.sum()) and [g.ex0, g.ey0, g.ex1, g.ey1] == box
        assert g.detected == (white.sum() > 200 if mode == "hatch" else dark.sum() > 100)
    assert (got[4].pixels, got[4].white, got[4].ex0, got[4].detected) == (0, 0, None, False) and not got[3].detected


def test_diagnosis_after_a_restart_in_the_middle(spark, tmp_path):
    schema = "collection_id int, page_index int, drawing_count int, image_count int, text_span_count int"
    drawings = spark.createDataFrame([(1, "#ff0000", "#222222", 0.0, 0.0, 5.0, 5.0), (2, "#ffffff", None, 0.0, 0.0, 1200.0, 1700.0), (3, None, "#222222", 1.0, 1.0, 2.0, 2.0)], "collection_id int, fill_hex string, stroke_hex string, x0 double, y0 double, w double, h double")
    spans = spark.createDataFrame([(3, "Zeleň a park"), (4, "text")], "collection_id int, raw_text string")
    rows = [(k % 5, k, k % 3, k % 2, k % 4) for k in range(40)]
    source, folder = tmp_path / "in", str(tmp_path / "out")
    part = lambda a, b: spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(source))
    run = lambda: st.page_diagnosis(spark.readStream.schema(schema).parquet(str(source)), drawings, spans, folder).awaitTermination()
    part(0, 12)
    run()
    part(12, 13)
    broken = st.e.diagnose
    st.e.diagnose = lambda *a: (_ for _ in ()).throw(RuntimeError("broken off"))
    try:
        with pytest.raises(Exception, match="broken off"):
            run()
    finally:
        st.e.diagnose = broken
    part(13, 40)
    run()
    told = lambda df: sorted(tuple(sorted(r.asDict().items())) for r in df.collect())
    every = spark.createDataFrame(rows, schema)
    assert told(st.read_diagnosis(spark, folder)) == told(e.diagnose(drawings, spans, every))
    assert {r.algorithm for r in st.read_diagnosis(spark, folder).collect()} >= {"vector_fill_style_polygon_v1", "diagnostic_only_v1", "raster_style_segmentation_v1"}
    pages = spark.read.parquet(f"{folder}/pages").drop("batch")
    assert told(pages) == told(e.source_type(every))


def test_crops(spark):
    schema = "collection_id int, span_index long, raw_text string, x0 double, y0 double, x1 double, y1 double, font_name string"
    many = [(1, 100 + k, "BI", 10.0 * k, 5.0, 10.0 * k + 4, 9.0, f"font{k:02d}") for k in range(30)]
    rows = [*many, (1, 99, "bydlení", 500.0, 500.0, 510.0, 510.0, "f"), (1, 98, "no target", 1.0, 1.0, 2.0, 2.0, "f"), (1, 200, "BI", 10.0, 5.0, 14.0, 9.0, "font01"), (2, 1, "RI", 500.0, 500.0, 510.0, 510.0, "f"), (3, 1, "RI", 0.0, 0.0, 1.0, 1.0, "f"), (5, 1, "other", 0.0, 0.0, 1.0, 1.0, "f")]
    spans = spark.createDataFrame(rows, schema)
    legends = spark.createDataFrame([(k, 0.0, 0.0, 400.0, 100.0, 0.7) for k in (1, 2, 4)], "collection_id int, bx0 double, by0 double, bx1 double, by1 double, score double")
    collections = spark.range(1, 6).selectExpr("cast(id as int) as collection_id")
    out = {}
    for r in lg.legend_crops(d.text_specs(spans), legends, collections).collect():
        out.setdefault(r.collection_id, {})[r.crop_id] = r
    one = out[1]["legend-autocrop-0001"]
    assert one.extracted_text == " ".join(["BI"] * 24) and (one.matched_code, one.matched_label, one.codes, one.confidence, one.anchor_text) == ("BI", None, 1, 0.7, "BI")
    assert len(out[1]) == 21 and out[1]["legend-text-anchor-0001"].matched_label == "B" and out[1]["legend-text-anchor-0001"].codes == 0
    assert out[2]["legend-autocrop-0001"].extracted_text == "RI" and out[2]["legend-text-anchor-0001"].reason is None  # none inside: the first ones
    assert list(out[3]) == ["legend-text-anchor-0001"] and out[3]["legend-text-anchor-0001"].reason == lg.NO_CROP
    assert out[4]["legend-autocrop-0001"].reason == lg.NO_TEXT and list(out[5]) == ["legend-unavailable-0001"]
