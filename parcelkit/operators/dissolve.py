"""Overlays of polygons: the union of each group's polygons, and what of one layer another one misses.

Only edges are worked on. Equal edges become one segment that knows which side a polygon of which layer lies on; a segment with a layer on
both sides is inside that layer's union and goes at once, so tiles that share whole edges never meet a join. The others are cut
where they meet in grid cells, and points beside the pieces tell what the layers cover there. A piece is on a result's border if one
side belongs to it and the other does not. Nothing so far needs a group in one task.

Border pieces become rings by tiles: each piece knows the one after it, a tile's task joins pieces to chains, and tiles grow by
levels, so that a task gets what crosses the borders of smaller tiles only. Holes find their outer ring by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.folders import written

RINGS = f"array<array<{g.POINT}>>"
#: Digits of coordinates while edges are cut, how far from a segment a point may lie to be on it, and how far from a piece its sides are looked at.
DIGITS, ON, BESIDE = 6, 2e-6, 1e-4
#: Tiles of the first level in cells, and how much they grow from level to level.
TILE, GROWTH = 32, 32
ENDS = ["ax", "ay", "bx", "by"]
SIDES = ["left0", "right0", "left1", "right1"]


def _rounded(value: Column) -> Column:
    return F.round(value, DIGITS) + 0.0  # no negative zero


def _segments(edges: DataFrame) -> DataFrame:
    """Rows (gid, ENDS, SIDES) as one row for each pair of ends, the smaller point first; those that no layer ends at go."""
    swap = (F.col("bx") < F.col("ax")) | ((F.col("bx") == F.col("ax")) & (F.col("by") < F.col("ay")))
    turned = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    other = dict(ax="bx", ay="by", bx="ax", by="ay", left0="right0", right0="left0", left1="right1", right1="left1")
    rows = edges.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).select("gid", *[turned(a, b).alias(a) for a, b in other.items()])
    rows = rows.groupBy("gid", *ENDS).agg(*[F.bool_or(s).alias(s) for s in SIDES])
    return rows.where("left0 <> right0 or left1 <> right1")


def _directed(polygons: DataFrame) -> DataFrame:
    """The edges of polygons (gid, layer 0 or 1, rings) with their own layer on the left: outer rings turn left, holes right."""
    rows = polygons.select("gid", "layer", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 2)
    points = F.transform(g.close_ring(F.col("points")), lambda p: F.struct(_rounded(p["x"]).alias("x"), _rounded(p["y"]).alias("y")))
    left = (g.ring_area_signed(F.col("points")) > 0) == (F.col("ring") == 0)
    rows = rows.withColumn("left", left).withColumn("points", points)
    n = F.size("points") - 1
    pairs = F.zip_with(F.slice("points", F.lit(1), n), F.slice("points", F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    rows = rows.select("gid", "layer", "left", F.explode(pairs).alias("e"))
    return rows.select("gid", "e.*", *[((F.col("layer") == k) & (F.col("left") if side == "left" else ~F.col("left"))).alias(f"{side}{k}") for k in (0, 1) for side in ("left", "right")])


def _spread(rows: DataFrame, cell: float) -> DataFrame:
    """Segments with the grid cells (gx, gy) that they pass, column by column."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rows = rows.withColumn("gx", F.explode(F.sequence(F.floor((F.col("ax") - ON) / cell), F.floor((F.col("bx") + ON) / cell))))
    y = lambda edge: F.col("ay") + F.when(dx == 0, 0.0).otherwise(F.least(F.greatest((edge - F.col("ax")) / F.nullif(dx, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))) * dy
    lo, hi = y(F.col("gx") * cell - ON), F.when(dx == 0, F.col("by")).otherwise(y((F.col("gx") + 1) * cell + ON))
    return rows.withColumn("gy", F.explode(F.sequence(F.floor((F.least(lo, hi) - ON) / cell), F.floor((F.greatest(lo, hi) + ON) / cell))))


def cut_segments(segments: DataFrame, cell: float) -> DataFrame:
    """Segments in pieces: cut where others of their group cross, touch or begin to run along them; pieces that come to lie on each other are one."""
    there = _spread(segments.select("gid", *ENDS), cell)
    other = there.select("gid", "gx", "gy", *[F.col(c).alias(f"o{c}") for c in ENDS])
    c, o = {k: F.col(k) for k in ENDS}, {k: F.col(f"o{k}") for k in ENDS}
    low, high = lambda e: F.least(e["ay"], e["by"]), lambda e: F.greatest(e["ay"], e["by"])
    differ = (c["ax"] != o["ax"]) | (c["ay"] != o["ay"]) | (c["bx"] != o["bx"]) | (c["by"] != o["by"])
    near = (c["ax"] <= o["bx"] + ON) & (o["ax"] <= c["bx"] + ON) & (low(c) <= high(o) + ON) & (low(o) <= high(c) + ON)
    both = there.join(other.hint("merge"), ["gid", "gx", "gy"]).where(differ & near)
    dx, dy, ex, ey = c["bx"] - c["ax"], c["by"] - c["ay"], o["bx"] - o["ax"], o["by"] - o["ay"]
    px, py = o["ax"] - c["ax"], o["ay"] - c["ay"]
    turn, long = dx * ey - dy * ex, F.hypot(dx, dy)
    t, u = (px * ey - py * ex) / F.nullif(turn, F.lit(0.0)), (px * dy - py * dx) / F.nullif(turn, F.lit(0.0))
    own = F.struct(*[c[k] for k in ENDS]) < F.struct(*[o[k] for k in ENDS])  # both segments work the point out from the same one
    x, y = F.when(own, c["ax"] + t * dx).otherwise(o["ax"] + u * ex), F.when(own, c["ay"] + t * dy).otherwise(o["ay"] + u * ey)
    crossed = F.when((F.abs(turn) > 1e-12) & (t > 0) & (t < 1) & (u > 0) & (u < 1), F.struct(t.alias("t"), _rounded(x).alias("x"), _rounded(y).alias("y")))

    def touched(x: Column, y: Column) -> Column:
        vx, vy = x - c["ax"], y - c["ay"]
        along = (vx * dx + vy * dy) / (long * long)
        return F.when((F.abs(vx * dy - vy * dx) <= ON * long) & (along > 0) & (along < 1), F.struct(along.alias("t"), x.alias("x"), y.alias("y")))

    cuts = both.select("gid", *ENDS, F.explode(F.filter(F.array(crossed, touched(o["ax"], o["ay"]), touched(o["bx"], o["by"])), lambda k: k.isNotNull())).alias("cut"))
    none = [F.lit(None).cast("boolean").alias(s) for s in SIDES]
    rows = segments.select("gid", *ENDS, *SIDES, F.lit(None).cast("struct<t:double,x:double,y:double>").alias("cut")).unionByName(cuts.select("gid", *ENDS, *none, "cut"))
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "gid", *ENDS).groupBy("gid", *ENDS).agg(*[F.bool_or(s).alias(s) for s in SIDES], F.collect_set("cut").alias("cuts"))
    stop = lambda t, x, y: F.struct(F.lit(t).alias("t"), x.alias("x"), y.alias("y"))
    rows = rows.withColumn("stops", F.array_sort(F.concat(F.array(stop(0.0, c["ax"], c["ay"]), stop(1.0, c["bx"], c["by"])), "cuts")))
    n = F.size("stops") - 1
    parts = F.zip_with(F.slice("stops", F.lit(1), n), F.slice("stops", F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return _segments(rows.select("gid", F.explode(parts).alias("part"), *SIDES).select("gid", "part.*", *SIDES))


def _level(extent: Column) -> Column:
    """The power of two of cells that an extent fits in."""
    return F.ceil(F.log2(F.greatest(extent, F.lit(1e-3)))).cast("int")


def _boxed(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Rows in the cells of their own level that their box touches: four at most."""
    rows = rows.withColumn("level", _level(F.greatest(x1 - x0, y1 - y0)))
    cell = F.pow(F.lit(2.0), F.col("level"))
    span = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    return rows.withColumn("gx", span(x0, x1)).withColumn("gy", span(y0, y1))


def _probed(rows: DataFrame, x: Column, y: Column, levels: list[int]) -> DataFrame:
    """Points in the cell of each level that boxes have."""
    rows = rows.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    cell = F.pow(F.lit(2.0), F.col("level"))
    return rows.withColumn("gx", F.floor(x / cell)).withColumn("gy", F.floor(y / cell))


def _levels(extents: DataFrame) -> list[int]:
    """The levels of ``extent``: powers of two, so a few dozen at most."""
    return sorted(r[0] for r in extents.select(_level(F.col("extent"))).distinct().collect())


def _sides(pieces: DataFrame, polygons: DataFrame, layers: int) -> DataFrame:
    """Pieces with SIDES complete: what the polygons cover at a point beside each side, where the pieces' own polygons do not tell."""
    b = g.bbox(F.col("rings"))
    boxes = polygons.withColumn("box", b).withColumn("extent", F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]))
    levels = _levels(boxes)
    cover = _boxed(boxes, F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1")).select(F.col("gid").alias("of"), "level", "gx", "gy", "layer", "rings", "box")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    known = lambda side: F.col(f"{side}0") if layers == 1 else F.col(f"{side}0") & F.col(f"{side}1")
    points = pieces.select("gid", *ENDS, F.explode(F.filter(F.array(F.when(~known("left"), F.lit(1)), F.when(~known("right"), F.lit(-1))), lambda s: s.isNotNull())).alias("side"))
    qx = (F.col("ax") + F.col("bx")) / 2 - F.col("side") * BESIDE * dy / F.hypot(dx, dy)
    qy = (F.col("ay") + F.col("by")) / 2 + F.col("side") * BESIDE * dx / F.hypot(dx, dy)
    points = _probed(points.withColumn("qx", qx).withColumn("qy", qy), F.col("qx"), F.col("qy"), levels)
    odd = F.aggregate(F.transform("rings", lambda r: g.point_in_ring(r, F.col("qx"), F.col("qy")).cast("int")), F.lit(0), lambda s, x: s + x) % 2 == 1
    p, v = points.alias("p"), cover.alias("v")
    same = (F.col("p.gid") == F.col("v.of")) & (F.col("p.level") == F.col("v.level")) & (F.col("p.gx") == F.col("v.gx")) & (F.col("p.gy") == F.col("v.gy"))
    inside = F.col("qx").between(F.col("box.x0"), F.col("box.x1")) & F.col("qy").between(F.col("box.y0"), F.col("box.y1"))
    hits = p.join(v.hint("merge"), same & inside).where(odd).select("gid", *ENDS, "side", "layer")
    told = hits.select("gid", *ENDS, *[((F.col("side") == s) & (F.col("layer") == k)).alias(f"{n}{k}") for k in (0, 1) for n, s in (("left", 1), ("right", -1))])
    return pieces.select("gid", *ENDS, *SIDES).unionByName(told).groupBy("gid", *ENDS).agg(*[F.bool_or(s).alias(s) for s in SIDES])


def overlaid(polygons: DataFrame, layers: int = 2, cell: float | None = None) -> DataFrame:
    """Pieces (gid, ENDS, SIDES) of the edges of polygons (gid, layer, rings), with what each layer covers on each side.

    ``cell``: the side of the grid cells in which edges meet; by default twice the mean extent of an edge.
    """
    polygons = written(polygons.select("gid", "layer", "rings").distinct(), "polygons")
    segments = written(_segments(_directed(polygons)), "segments")
    if cell is None:
        mean = segments.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).head()[0]
        cell = max(1e-2, 2.0 * (mean or 1.0))
    return _sides(written(cut_segments(segments, cell), "pieces"), polygons, layers)


def border(pieces: DataFrame, left: Column, right: Column) -> DataFrame:
    """The directed pieces (gid, ENDS) with the result to their left, which covers ``left`` and ``right`` of a piece."""
    turned = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b)).alias(a)
    return pieces.where(left != right).select("gid", *[turned(a, b) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])


def border_area(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, perimeter) that directed pieces enclose, summed per row of keys; no ring is made."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return pieces.groupBy(*keys).agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"), F.sum(F.hypot(dx, dy)).alias("perimeter"))


_CHAIN = "gid long, head string, next string, xs array<double>, ys array<double>, area double"


def _closed(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """A ring without points on straight lines, and its signed area; none if nothing is left."""
    while len(xs) >= 3:
        ax, ay, bx, by = xs - np.roll(xs, 1), ys - np.roll(ys, 1), np.roll(xs, -1) - xs, np.roll(ys, -1) - ys
        keep = np.abs(ax * by - ay * bx) > ON * (np.hypot(ax, ay) + np.hypot(bx, by))
        if keep.all():
            return xs, ys, float((xs * np.roll(ys, -1) - np.roll(xs, -1) * ys).sum() / 2)
        xs, ys = xs[keep], ys[keep]
    return None


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile's chains joined where one's next is another's head; those that come back to their head are rings (next null)."""
    heads, nexts, xs, ys, area = (pdf[c].tolist() for c in ("head", "next", "xs", "ys", "area"))
    at = {h: i for i, h in enumerate(heads)}
    gid, out, used = pdf["gid"].iloc[0], [], [False] * len(heads)
    later = {n for n in nexts if n in at}
    for start in [*[h for h in heads if h not in later], *heads]:
        i, run = at[start], []
        while i is not None and not used[i]:
            used[i] = True
            run.append(i)
            i = at.get(nexts[i])
        if not run:
            continue
        x, y = (np.concatenate([np.asarray(v[k], float) for k in run]) for v in (xs, ys))
        if nexts[run[-1]] != start:
            out.append((gid, start, nexts[run[-1]], x, y, None))
        elif (ring := _closed(x, y)) is not None:
            out.append((gid, start, None, *ring))
    return pd.DataFrame(out, columns=["gid", "head", "next", "xs", "ys", "area"])


def rings(pieces: DataFrame, tile: float) -> DataFrame:
    """(gid, xs, ys, area) for each ring of directed pieces (gid, ENDS): open, without straight corners, area negative for holes.

    Where rings touch in a point the way turns left, so that each stays by itself. ``tile``: the side of the tiles in which the first chains are made.
    """
    ahead = pieces.select("gid", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("nx"), F.col("by").alias("ny"))
    back, out = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")), F.atan2(F.col("ny") - F.col("by"), F.col("nx") - F.col("bx"))
    name = lambda *c: F.concat_ws(" ", *c)
    linked = pieces.join(ahead.hint("merge"), ["gid", "bx", "by"]).withColumn("turn", F.pmod(back - out, F.lit(2 * math.pi)))
    linked = linked.groupBy("gid", *ENDS).agg(F.min_by(F.struct("nx", "ny"), "turn").alias("to"))
    chains = linked.select("gid", name(*ENDS).alias("head"), name("bx", "by", "to.nx", "to.ny").alias("next"), F.array("ax").alias("xs"), F.array("ay").alias("ys"), F.lit(None).cast("double").alias("area"))
    found, tasks = None, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are small beside the work: Spark would put too many into a task
    for level in range(3):
        if level < 2:
            size = tile * GROWTH**level
            chains = chains.withColumn("tx", F.floor(F.get("xs", F.lit(0)) / size)).withColumn("ty", F.floor(F.get("ys", F.lit(0)) / size))
            chains = chains.repartition(tasks, "gid", "tx", "ty").groupBy("gid", "tx", "ty").applyInPandas(_joined, _CHAIN)
        else:
            chains = chains.groupBy("gid").applyInPandas(_joined, _CHAIN)
        chains = written(chains, "chains")
        done = chains.where("next is null")
        found = done if found is None else found.union(done)
        chains = chains.where("next is not null")
    return found.drop("head", "next")


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rings with a point just right of their first edge: inside a hole."""
    for pdf in batches:
        p = []
        for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True):
            dx, dy = xs[1] - xs[0], ys[1] - ys[0]
            n = math.hypot(dx, dy)
            p.append(((xs[0] + xs[1]) / 2 + BESIDE * dy / n, (ys[0] + ys[1]) / 2 - BESIDE * dx / n))
        yield pdf.assign(px=[x for x, _ in p], py=[y for _, y in p])


def polygons_of(found: DataFrame) -> DataFrame:
    """(gid, rings, area, holes) from :func:`rings`: each hole in the smallest outer ring around it."""
    point = lambda x, y: F.struct(F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
    ring = lambda: F.transform(F.concat(F.arrays_zip("xs", "ys"), F.slice(F.arrays_zip("xs", "ys"), 1, 1)), lambda p: point(p["xs"], p["ys"]))
    found = found.withColumn("ring", ring()).withColumn("shape", F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y"))))
    outer = found.where("area > 0").select("gid", "ring", "shape", "area", F.md5(F.to_json("shape")).alias("id"))
    xs, ys = F.transform("shape", lambda p: p["x"]), F.transform("shape", lambda p: p["y"])
    boxes = outer.select("gid", "id", "shape", "area", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    levels = _levels(boxes.select(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("extent")))
    boxes = _boxed(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    holes = found.where("area < 0").select("gid", "xs", "ys", "ring", F.col("area").alias("hole_area"))
    holes = _probed(holes.mapInPandas(_probe, f"gid long, xs array<double>, ys array<double>, ring array<{g.POINT}>, hole_area double, px double, py double"), F.col("px"), F.col("py"), levels)
    inside = holes.join(boxes.hint("merge"), ["gid", "level", "gx", "gy"]).where(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    inside = inside.where(g.point_in_ring(F.col("shape"), F.col("px"), F.col("py")))
    owned = inside.groupBy("gid", "px", "py").agg(F.min_by(F.struct("id", "ring", "hole_area"), F.struct("area", "id")).alias("o"))
    owned = owned.groupBy("gid", F.col("o.id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o.ring").alias("ring")))).alias("inner"), F.sum("o.hole_area").alias("less"))
    rows = outer.join(owned.hint("shuffle_hash"), ["gid", "id"], "left")
    inner = F.coalesce(F.transform("inner", lambda h: h["ring"]), F.array().cast(RINGS))
    return rows.select("gid", F.concat(F.array("ring"), inner).alias("rings"), (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"), F.size(inner).alias("holes"))


def _grouped(layers: list[DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The layers' polygons (gid, layer, rings) with a number for each row of ``keys``, and these rows by number."""
    rows = [df.select(F.struct(*keys).alias("group"), F.lit(k).alias("layer"), "rings") for k, df in enumerate(layers)]  # structs with equal nulls are equal
    every = rows[0]
    for more in rows[1:]:
        every = every.union(more)
    groups = written(every.select(F.xxhash64("group").alias("gid"), "group").distinct(), "groups")
    if not groups.groupBy("gid").count().where("count > 1").isEmpty():
        raise ValueError("two groups have the same 64-bit hash; dissolve them apart")
    return every.select(F.xxhash64("group").alias("gid"), "layer", "rings"), groups


def _components(found: DataFrame, groups: DataFrame, keys: list[str], least_area: float) -> DataFrame:
    rows = polygons_of(found).where(F.col("area") >= least_area)
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("area"), first["x"], first["y"]))
    rows = rows.withColumn("component", number).join(groups.hint("shuffle_hash"), "gid")
    return rows.select(*[F.col("group")[k].alias(k) for k in keys], "component", "rings", "area", "holes")


def _tile(cell: float | None, pieces: DataFrame) -> float:
    if cell is None:
        cell = 2.0 * (pieces.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).head()[0] or 1.0)
    return TILE * cell


def dissolve(polygons: DataFrame, keys: list[str], least_area: float = 10.0, cell: float | None = None) -> DataFrame:
    """One row per connected polygon of each group's union: ``keys``, component (from 1, largest first), rings (closed, three digits), area and holes.

    ``polygons`` has ``keys`` (null is a value) and rings, the outer one first. Polygons that touch along an edge merge, those that
    touch in a point only stay apart. Components below ``least_area`` go; an empty table gives an empty result. Other columns are ignored.
    """
    rows, groups = _grouped([polygons], keys)
    pieces = written(border(overlaid(rows, 1, cell), F.col("left0"), F.col("right0")), "border")
    return _components(rings(pieces, _tile(cell, pieces)), groups, keys, least_area)


def _residual_edges(source: DataFrame, generated: DataFrame, keys: list[str], cell: float | None) -> tuple[DataFrame, DataFrame]:
    rows, groups = _grouped([source, generated], keys)
    pieces = written(overlaid(rows, 2, cell), "overlay")
    only = lambda side, k: F.col(f"{side}{k}") & ~F.col(f"{side}{1 - k}")
    kinds = [border(pieces, only("left", k), only("right", k)).withColumn("kind", F.lit(kind)) for k, kind in enumerate(("missing", "extra"))]
    return kinds[0].union(kinds[1]), groups


def residual_areas(source: DataFrame, generated: DataFrame, keys: list[str], cell: float | None = None) -> DataFrame:
    """(keys, kind, area, perimeter) with kind missing (of ``source`` but not of ``generated``) or extra (the reverse), for each row of ``keys`` that has any.

    Both have ``keys`` and rings; each side counts as the union of its polygons. No polygon is put together.
    """
    edges, groups = _residual_edges(source, generated, keys, cell)
    rows = border_area(edges, ["gid", "kind"]).join(groups.hint("shuffle_hash"), "gid")
    return rows.select(*[F.col("group")[k].alias(k) for k in keys], "kind", "area", "perimeter")


def residuals(source: DataFrame, generated: DataFrame, keys: list[str], least_area: float = 0.0, cell: float | None = None) -> DataFrame:
    """The polygons of :func:`residual_areas`: ``keys``, kind, component, rings, area and holes, as :func:`dissolve` gives them."""
    edges, groups = _residual_edges(source, generated, keys, cell)
    own = F.xxhash64("gid", "kind")
    named = written(edges.select(own.alias("gid"), *ENDS), "border")
    kinds = groups.select("gid", F.col("group"), F.explode(F.array(F.lit("missing"), F.lit("extra"))).alias("kind"))
    kinds = kinds.select(own.alias("gid"), F.struct("group.*", "kind").alias("group"))
    return _components(rings(named, _tile(cell, named)), kinds, [*keys, "kind"], least_area)


#: Roles whose fragments are merged, the region they must lie in, fragments of a group at least, and sample ids kept of it at most.
TRUSTED, BODY, LEAST, SAMPLES = ("area_fill_candidate", "tessellated_area_fragment"), "map_body_region", 2, 12


def merged_features(fragments: DataFrame, metrics: DataFrame, style: list[str], least_area: float = 10.0) -> DataFrame:
    """The primary features of each collection: (collection_id, mode, fid, ``style``, component, fragments, invalid, raw_area, components, samples, area, holes, rings).

    ``fragments`` has collection_id, drawing_index, role, region, area, rings and the columns ``style``; ``metrics`` says by collection_id whether it is detected as a tessellation. Where it is, trusted fragments
    of the map's body are dissolved by style: groups of fewer than LEAST go, as do components below ``least_area``. fid numbers a collection's components, those of the group with most fragments first. fragments, invalid
    (without an area), raw_area and samples (the smallest drawing indices) are the group's, components how many it came to. Where it is not detected, each fragment passes as it is (mode raw_fragments).
    """
    rows = fragments.join(metrics.select("collection_id", "detected").hint("shuffle_hash"), "collection_id")
    keys = ["collection_id", *style]
    trusted = rows.where(F.col("detected") & F.col("role").isin(*TRUSTED) & (F.col("region") == BODY))
    invalid = F.coalesce(F.col("area"), F.lit(0.0)) <= 0
    near = Window.partitionBy(*keys).orderBy("drawing_index")
    sample = trusted.select(*keys, "drawing_index", F.row_number().over(near).alias("_n")).where(F.col("_n") <= SAMPLES).groupBy(*keys).agg(F.array_sort(F.collect_list("drawing_index")).alias("samples"))
    groups = trusted.groupBy(*keys).agg(F.count("*").alias("fragments"), F.count_if(invalid).alias("invalid"), F.sum(F.col("area").cast("decimal(18,3)")).alias("raw_area")).where(F.col("fragments") >= LEAST)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    groups = written(groups.join(sample.hint("shuffle_hash"), same(groups, sample)).select(*[groups[k] for k in keys], "fragments", "invalid", "raw_area", "samples"), "groups")
    worked = trusted.where(~invalid).join(groups.hint("shuffle_hash"), same(trusted, groups), "left_semi")
    merged = dissolve(worked.select(*keys, "rings"), keys, least_area)
    merged = merged.join(groups.hint("shuffle_hash"), same(merged, groups)).select(*[merged[k] for k in keys], "component", "rings", "area", "holes", "fragments", "invalid", "raw_area", "samples")
    order = Window.partitionBy("collection_id").orderBy(F.desc("fragments"), *[F.asc_nulls_first(c) for c in style], "component")
    merged = merged.withColumn("components", F.count("*").over(Window.partitionBy(*keys))).withColumn("fid", F.row_number().over(order)).withColumn("mode", F.lit("merged_polygons"))
    raw = rows.where(~F.col("detected"))
    passed = raw.select(
        "collection_id", *style, F.lit(1).alias("component"), "rings", F.col("area").cast("double").alias("area"), F.greatest(F.size("rings") - 1, F.lit(0)).alias("holes"), F.lit(1).cast("long").alias("fragments"), invalid.cast("long").alias("invalid"),
        F.col("area").cast("decimal(18,3)").cast("decimal(28,3)").alias("raw_area"), F.array("drawing_index").alias("samples"), F.lit(1).cast("long").alias("components"), F.col("drawing_index").cast("int").alias("fid"), F.lit("raw_fragments").alias("mode"),
    )
    columns = ["collection_id", "mode", "fid", *style, "component", "fragments", "invalid", "raw_area", "components", "samples", "area", "holes", "rings"]
    return merged.select(*columns).unionByName(passed.select(*columns))


def quality_gate(fragments: DataFrame, metrics: DataFrame, features: DataFrame) -> DataFrame:
    """(collection_id, raw, primary_features, warn): warn where a detected tessellation has as many primary ``features`` (of :func:`merged_features`) as raw fragments, or more."""
    raw = fragments.groupBy("collection_id").agg(F.count("*").alias("raw"))
    primary = features.groupBy("collection_id").agg(F.count("*").alias("primary_features"))
    rows = raw.join(primary.hint("shuffle_hash"), "collection_id", "left").join(metrics.select("collection_id", "detected").hint("shuffle_hash"), "collection_id").na.fill(0, ["primary_features"])
    return rows.select("collection_id", "raw", "primary_features", (F.col("detected") & (F.col("primary_features") >= F.col("raw"))).alias("warn"))
