"""Evidence in page images: pixels of hatches, fills and dots, counted tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A channel's least value in white, and the most in dark; red's least red and most green and blue; counts above which hatches and dots are found.
WHITE, DARK, RED, NOT_RED = 232, 45, 170, 120
HATCH_PIXELS, DOT_PIXELS = 200, 100
# End of fixed values.
_PART = "collection_id long, pixels long, white long, red long, dark long, px0 long, py0 long, px1 long, py1 long"


def _counted(mode: str):
    """Of each tile (collection_id, left, top, width, channels, samples): counts, and the box of the pixels that ``mode`` looks for. A tile without them has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, left, top, width, n, samples in zip(*(batch.column(c) for c in ("collection_id", "left", "top", "width", "channels", "samples")), strict=True):
                width, n = width.as_py(), n.as_py()
                data = np.frombuffer(samples.as_buffer() if samples.is_valid else b"", np.uint8)
                if not width or not n or n < 3 or len(data) % (width * n):
                    raise ValueError(f"a tile of {len(data)} bytes has no whole rows of {width} pixels of {n} channels")
                rgb = data.reshape(-1, width, n)[:, :, :3]
                low, high = rgb.min(axis=2), rgb.max(axis=2)
                white, dark = low >= WHITE, high <= DARK
                red = (rgb[:, :, 0] >= RED) & (rgb[:, :, 1:].max(axis=2) <= NOT_RED)
                y, x = np.nonzero(white if mode == "hatch" else dark)
                box = [int(left.as_py() + x.min()), int(top.as_py() + y.min()), int(left.as_py() + x.max()), int(top.as_py() + y.max())] if len(x) else [None] * 4
                rows.append((own.as_py(), low.size, int(white.sum()), int(red.sum()), int(dark.sum()), *box))
            names = [c.split()[0] for c in _PART.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    return run


def raster_evidence(tiles: DataFrame, regions: DataFrame, mode: str) -> DataFrame:
    """One row per collection of ``regions`` (collection_id, x0, y0: the region's corner on the page, scale: pixels of a point).

    ``tiles``: (collection_id, left, top: its place in the region's image, width, channels, samples: rows of pixels, red, green and blue first). ``mode`` hatch looks for white pixels, dots
    for dark ones. Columns: pixels, white, red and dark counts, ex0 to ey1 (the envelope of what was looked for, on the page, three digits; null without any), detected, and hatch_orientations or dot_candidates.
    Each tile is looked at by itself, and only counts and boxes leave its task, so a region's image is never put together. Regions without tiles count 0. Tiles that
    hold no whole rows are an error.
    """
    if mode not in ("hatch", "dots"):
        raise ValueError("mode is hatch or dots")
    own = tiles.select(F.col("collection_id").cast("long").alias("collection_id"), F.col("left").cast("long").alias("left"), F.col("top").cast("long").alias("top"), F.col("width").cast("int").alias("width"), F.col("channels").cast("int").alias("channels"), "samples")
    parts = own.mapInArrow(_counted(mode), _PART).groupBy("collection_id").agg(
        *[F.sum(c).alias(c) for c in ("pixels", "white", "red", "dark")], F.min("px0").alias("px0"), F.min("py0").alias("py0"), F.max("px1").alias("px1"), F.max("py1").alias("py1")
    )
    rows = regions.select("collection_id", "x0", "y0", "scale").join(parts.hint("shuffle_hash"), "collection_id", "left").na.fill(0, ["pixels", "white", "red", "dark"])
    page = lambda corner, pixel: F.round(F.col(corner) + F.col(pixel) / F.col("scale"), 3)
    found = F.col("white") > HATCH_PIXELS if mode == "hatch" else F.col("dark") > DOT_PIXELS
    extra = F.when(found, 2).otherwise(0).alias("hatch_orientations") if mode == "hatch" else F.col("dark").alias("dot_candidates")
    return rows.select("collection_id", "pixels", "white", "red", "dark", page("x0", "px0").alias("ex0"), page("y0", "py0").alias("ey0"), page("x0", "px1").alias("ex1"), page("y0", "py1").alias("ey1"), found.alias("detected"), extra)
