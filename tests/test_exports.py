"""Readers with errors, exports read back, layers that are written again, folding of all letters."""

import json
import os
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from parcelkit.functions import texts as tx
from parcelkit.sources import exports as ex


def test_good_bad_and_short_rows(spark, tmp_path):
    rect, items = {"x0": 0, "y0": 0, "x1": 2, "y1": 2}, [{"op": "l", "points": [{"x": 0, "y": 0}, {"x": 1, "y": 1}]}]
    good = [{"collection_id": 1, "drawing_index": k, "rect": rect, "items": items, "width": 0.5, "fill": [0, 0.5, 1], "more": "ignored"} for k in range(3)]
    lines = [*map(json.dumps, good), "{broken", json.dumps({"collection_id": 1, "drawing_index": 9, "rect": rect}), json.dumps({**good[0], "width": "wide"}), "", "[]", json.dumps({"a": 1})]
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.json").write_text("\n".join(lines[:4]))
    (tmp_path / "d" / "sub" / "b.json").write_text("\n".join(lines[4:]))
    rows, errors = ex.read_drawings(spark, str(tmp_path / "d"))
    assert sorted((r.drawing_index, r.width, r.fill[1], r["items"][0].points[1].x, os.path.basename(r.source_file)) for r in rows.collect()) == [(k, 0.5, 0.5, 1.0, "a.json") for k in range(3)]
    told = {r.record: r.reason for r in errors.collect()}
    assert told["{broken"] == "not_of_the_declared_form" and told[lines[4]] == "missing: items" and told[lines[5]] == "not_of_the_declared_form"
    assert told[lines[8]] == "missing: collection_id, drawing_index, rect, items" and len(told) == 5
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.json").write_text(json.dumps({"collection_id": 1, "text": "BI", "bbox": [0, 0, 1, 1]}) + "\n" + json.dumps({"collection_id": 1, "text": "BI"}))
    spans, wrong = ex.read_spans(spark, str(tmp_path / "s"))
    assert [r.text for r in spans.collect()] == ["BI"] and [r.reason for r in wrong.collect()] == ["missing: bbox"]


def test_exports_read_back_equal(spark, tmp_path):
    run = spark.createDataFrame([(1, "run-1", "a.pdf"), (2, "run-2", "b.pdf")], "collection_id long, run_id string, source_filename string")
    rows = spark.createDataFrame([(1, "x,\"y\"\nz", {"b": 1, "a": None}, "own"), (2, "é;", None, None), (1, None, {}, None)], "collection_id long, label string, details map<string,int>, run_id string")
    tables = {kind: rows for kind in ex.EXPORTS}
    folder = str(tmp_path / "out")
    assert len(ex.export_records(tables, run, folder)) == 15
    want = sorted([("own", "a.pdf", "x,\"y\"\nz"), ("run-2", "b.pdf", "é;"), ("run-1", "a.pdf", None)], key=str)
    for kind, form in ex.EXPORTS.items():
        got = ex.read_export(spark, folder, kind)
        assert sorted(((r.run_id, r.source_filename, r.label) for r in got.collect()), key=str) == want, kind
        assert {n for n in got.columns} == {"collection_id", "details", "label", "run_id", "source_filename"}
        if form == "csv":
            assert got.columns == sorted(got.columns) and '{"a":null,"b":1}' in {r.details for r in got.collect()}
    names = {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs}
    assert any("collection=1" in n and "pipeline_traces.jsonl" in n for n in names)
    first = spark.read.text(f"{folder}/pipeline_traces.jsonl").first()[0]
    assert list(json.loads(first)) == sorted(json.loads(first))
    ex.export_records({"legend_rows": rows.where("collection_id = 2").withColumn("label", F.lit("new"))}, run, folder)
    assert sorted(str(r.label) for r in ex.read_export(spark, folder, "legend_rows").collect()) == sorted(["new", "None", "x,\"y\"\nz"])
    with pytest.raises(KeyError):
        ex.export_records({"legend_rows": rows, "nonsense": rows}, run, str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")


def test_layers_written_again_and_after_a_break(spark, tmp_path):
    raw = spark.createDataFrame([(1, "f1", 10.0), (1, "f2", 5.0), (2, "f3", 7.0), (2, "f3", 7.0)], "collection_id long, fid string, area double")
    edits = spark.createDataFrame([(1, "e1", "f1", 12.0)], "collection_id long, edit_id string, fid string, area double")
    state = {"break": False}

    def core(done):
        if state["break"]:
            raise RuntimeError("broken off")
        edited = done["manual"].select("collection_id", "fid", F.col("area").alias("edited"))
        return done["staging"].join(edited, ["collection_id", "fid"], "left").select("collection_id", "fid", F.coalesce("edited", "area").alias("area"))

    def tables(rows):
        return {"import": rows, "staging": lambda done: done["import"].where("area >= 6"), "manual": edits, "core": core, "api": lambda done: done["core"].select("collection_id", F.to_json(F.struct("fid", "area")).alias("feature"))}

    keys, folder = {"import": ["collection_id", "fid"], "manual": ["collection_id", "edit_id"]}, str(tmp_path / "layers")
    read = lambda done: {n: sorted(map(str, (sorted(r.asDict().items()) for r in df.collect()))) for n, df in done.items()}
    state["break"] = True
    with pytest.raises(RuntimeError):
        ex.write_layers(spark, folder, tables(raw), keys, raw)
    state["break"] = False
    first = read(ex.write_layers(spark, folder, tables(raw), keys, raw))
    assert [len(first[n]) for n in ex.LAYERS] == [3, 2, 1, 2, 2] and any("12.0" in x for x in first["core"])
    assert read(ex.write_layers(spark, folder, tables(raw), keys, raw)) == first
    changed = spark.createDataFrame([(2, "f3", 1.0), (2, "f4", 2.0)], "collection_id long, fid string, area double")
    later = read(ex.write_layers(spark, folder, {**tables(changed), "staging": lambda done: done["import"].where("area >= 8")}, keys, changed))
    assert [len(later[n]) for n in ex.LAYERS] == [4, 1, 1, 1, 1]  # what was imported stays; collection 2 has no staging rows any more, 1 keeps its own
    assert any("7.0" in x for x in later["import"]) and not any("'fid', 'f3'), " in x and "1.0" in x for x in later["import"])


def test_folding_of_all_letters(spark):
    letters = [chr(k) for k in range(1, sys.maxunicode + 1) if unicodedata.category(chr(k))[0] in "LM" or k <= 0x24F]
    words = [*("".join(letters[k : k + 50]) for k in range(0, len(letters), 50)), "Straße ŽLUŤ ﬁn", "", None, "abc", *[chr(k) for k in [*range(1, 0x250), *range(0x1E00, 0x1F00)]]]
    df = spark.createDataFrame([(w,) for w in words], "t string").repartition(8)
    wrong = [r for r in df.select("t", tx.fold_text(F.col("t")).alias("f")).collect() if r.f != tx.folded(r.t or "")]
    assert wrong == []
    spaced = spark.createDataFrame([("  A\t b\n c　 ",), (None,)], "t string")
    assert [r[0] for r in spaced.select(tx.normalized_text(F.col("t"))).collect()] == ["a b c", ""]
