"""What keeps the work of large tables spread: numbers in chunks, rings worked out once, labels looked for inside cells."""

import math
import random

from pyspark.sql import functions as F

from parcelkit.functions import geometry as g
from parcelkit.operators import annotation as an
from parcelkit.operators import documents as d
from parcelkit.operators import paths as p
from parcelkit.plans import annotation, catalogue
from parcelkit.plans.views import view
from parcelkit.sources import exports as ex
from tests.test_catalogue import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fragments_are_numbered_in_chunks(spark):
    """No window holds a collection's fragments whole, and what does not read the number does not sort for it."""
    rows = view(spark, SF, "v_fragments")
    ranks = [line for line in plan(rows).split("\n") if "Window" in line and "row_number()" in line]
    assert ranks and all("_chunk" in line.split("windowspecdefinition")[1] for line in ranks)
    assert "Window" not in plan(rows.select("collection_id", "x0")) and "Join" not in plan(rows.select("collection_id", "x0"))


def test_numbers_across_chunks(spark):
    """Gaps, negative keys and nulls; equal keys go on by the next column."""
    keys = [-9000, -4097, -4096, -1, 0, 0, 4095, 4096, 10**12, None]
    rows = [(c, k, i) for c in (0, 1) for i, k in enumerate(keys)]
    got = p.numbered(spark.createDataFrame(rows, "collection_id int, k long, i long"), "n", "k", "i").collect()
    for c in (0, 1):
        assert [r.i for r in sorted((r for r in got if r.collection_id == c), key=lambda r: r.n)] == [9, *range(9)]
        assert sorted(r.n for r in got if r.collection_id == c) == list(range(1, 11))


def test_ring_in_a_filter_is_worked_out_once(spark):
    """A filter goes below the projection that makes the rings, and takes their expression along."""
    rows = d.rings(view(spark, SF, "v_fragments")).where(g.point_in_ring(F.get("rings", F.lit(0)), F.col("x0"), F.col("y0"))).groupBy("shape").count()
    condition = next(line for line in plan(rows).split("\n") if "Filter" in line and "aggregate" in line)
    assert condition.count("= tri") == 2  # with a hole and without


def test_nearest_labels_against_all_pairs(spark):
    """Large boxes and small ones, many texts at one place and none; features meet texts inside cells, not as rows of a join."""
    rng = random.Random(4)
    boxes = [(i % 2, i, rng.uniform(-300, 900), rng.uniform(-300, 900), rng.choice([0.0, 2.0, 40.0, 500.0]), rng.choice([0.0, 3.0, 300.0])) for i in range(300)] + [(0, 300, None, 1.0, 2.0, 2.0)]
    places = [(rng.uniform(-300, 900), rng.uniform(-300, 900)) for _ in range(60)]
    spans = [(i % 2, i, rng.choice(["BI", "SX", "návrh plochy"]), x, y, x + 16.0, y + 12.0) for i, (x, y) in enumerate(rng.choices(places, k=500))]
    f = spark.createDataFrame(boxes, "collection_id int, drawing_index int, x0 double, y0 double, w double, h double")
    t = spark.createDataFrame(spans, "collection_id int, span_index long, raw_text string, x0 double, y0 double, x1 double, y1 double")
    out = d.associate_labels(f, t)
    want = set()
    for c, i, x, y, w, h in boxes[:-1]:
        found = []
        for k, n, text, a, b, a1, b1 in spans:
            if k == c and text != "návrh plochy":
                tx, ty = (a + a1) / 2, (b + b1) / 2
                inside = x - 18 <= tx <= x + w + 18 and y - 18 <= ty <= y + h + 18
                away = math.sqrt((tx - (x + (x + w)) / 2) ** 2 + (ty - (y + (y + h)) / 2) ** 2)
                if inside or away <= 35:
                    found.append((0.0 if inside else away, n))
        if found:
            want.add((c, i, min(found)[1], round(min(found)[0], 9)))
    assert {(r.collection_id, r.drawing_index, r.span_index, round(r.score, 9)) for r in out.collect()} == want and len(want) > 100
    assert "FlatMapCoGroupsInArrow" in plan(out)
    assert "h6_nearest_labels" in catalogue.QUERIES


def test_lines_are_parsed_once_in_a_filter(spark, tmp_path):
    """What decides whether a line is good reads its fields from one parse."""
    (tmp_path / "a.json").write_text('{"collection_id": 1}\n')
    _, errors = ex.read_drawings(spark, str(tmp_path))
    assert [r.reason for r in errors.collect()] == ["missing: drawing_index, rect, items"]
    condition = next(line for line in plan(errors.select("reason")).split("\n") if "Filter" in line and "from_json" in line)
    assert condition.count("from_json(") == 1


def test_features_are_not_dealt_out_by_code(spark):
    """Legends and profiles are broadcast; counts of a collection are one aggregate over its features."""
    rows = annotation._annotated(spark, SF).select("collection_id", "proposed_class", "missing")
    joins = [line for line in rows._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line and "target_code" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    assert plan(annotation._profiles(annotation._features(spark, SF))).count("row_number()") == 1


def test_found_features_and_styles_are_worked_out_once(spark):
    """Queries that read them twice read a written table: no fragment is numbered above it."""
    for name in ("i9_artifact_diagnostics", "e4_whole_styles"):
        assert "l_orderkey" not in plan(catalogue.QUERIES[name](spark, SF)), name


SWATCHES = "collection_id int, code string, span_index long, role string, sx0 double, sy0 double, sx1 double, sy1 double"
STYLED = "collection_id int, k long, m int, x0 double, y0 double, w double, h double, fill_hex string, stroke_hex string, stroke_width double"


def test_dominant_styles_against_all_pairs(spark):
    """Swatches at one place and apart, large and endless features, no boxes, ties and equal first columns; no row of a swatch with a feature is shuffled."""
    rng = random.Random(5)
    places = [(rng.uniform(0, 500), rng.uniform(0, 500)) for _ in range(12)]
    swatches = [(i % 2, rng.choice(["BI", "SX"]), i, "ignored_extra", x, y, x + 86.0, y + 40.0) for i, (x, y) in enumerate(rng.choices(places, k=80))] + [(2, "BI", 80, "navrh", 0.0, 0.0, 86.0, 40.0), (0, "BI", 81, "navrh", None, 0.0, 86.0, 40.0)]
    colours, strokes = [None, "", "#ffffff", "#000000", "#d9483f", "#86b37f", "#ff0000"], [None, "", "#ffffff", "#222222", "#ff0000"]
    own = lambda i: (rng.choice(colours), rng.choice(strokes), rng.choice([None, 0.0, 0.4, 2.0]))
    features = [(i % 2, -5000 + i // 3 * 700, 1200 - i, rng.uniform(-200, 900), rng.uniform(-200, 900), rng.choice([0.0, -5.0, 3.0, 300.0]), rng.choice([0.5, 200.0]), *own(i)) for i in range(1200)]
    features += [(0, 1, 1300, None, 1.0, 2.0, 2.0, *own(0)), (1, 1, 1301, 1.0, 1.0, 900.0, None, *own(1)), (1, 2, 1302, 1.0, 1.0, math.inf, 900.0, "#86b37f", "#222222", 0.4)]
    rng.shuffle(features)
    s, f = spark.createDataFrame(swatches, SWATCHES), spark.createDataFrame(features, STYLED)

    def best(values):
        found = {}
        for at, v in values:
            n, first = found.get(v, (0, at))
            found[v] = (n + 1, min(first, at))
        return min(found, key=lambda v: (-found[v][0], found[v][1])) if found else None

    want, seen = set(), 0
    for c, code, i, _, a0, b0, a1, b1 in swatches:
        box = None if a0 is None else (a0 - 10, b0 - 8, a1 + 10, b1 + 8)
        near = [r for r in features if r[0] == c and box and None not in r[3:7] and min(r[3] + r[5], box[2]) > max(r[3], box[0]) and min(r[4] + r[6], box[3]) > max(r[4], box[1])]
        told = [best([(r[1:3], r[j]) for r in near if r[j] is not None and r[j] not in out]) for j, out in ((7, ("", "#ffffff", "#000000")), (8, ("", "#ffffff")), (9, ()))]
        want.add((c, code, i, len(near), *told))
        seen += len(near)
    numbered = f.withColumn("drawing_index", F.col("k") * 10000 + F.col("m"))
    out = an.dominant_styles(s, numbered)
    grouped = [line.split("Aggregate [")[1].split("]")[0] for line in plan(out).split("\n") if "Aggregate [" in line]
    assert grouped and not any("drawing_index" in g or "span_index" in g or "nth" in g for g in grouped)
    for rows in (out, an.dominant_styles(s, f, order=("k", "m"))):
        got = [tuple(r) for r in rows.select("collection_id", "code", "span_index", "near", "symbol_fill", "symbol_stroke", "symbol_width").collect()]
        assert set(got) == want and len(got) == len(swatches)
    assert seen > 500


def test_styles_number_only_fragments_at_the_legend(spark):
    """Fragments outside the extent of all swatches go before the numbering, which deals out whole rows."""
    lines = plan(annotation._styled(spark, SF)).split("\n")
    ranks = [i for i, line in enumerate(lines) if "Window" in line and "row_number()" in line and "_chunk" in line.split("windowspecdefinition")[1]]
    assert ranks and all(any("Join Inner" in line and "ex0" in line for line in lines[i:i + 6]) for i in ranks)
    assert {"f9_dominant_styles", "f11_legend_definitions"} <= set(catalogue.QUERIES)


def test_styles_without_swatches(spark):
    """Nothing has an extent then, so no feature is dealt out, not even an endless one."""
    f = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, math.inf, 1.0, "#86b37f", None, None)], STYLED)
    assert an.dominant_styles(spark.createDataFrame([], SWATCHES), f, order=("k", "m")).count() == 0
