"""A stored layout in Z-order tiles, so that a view or a hover reads the tiles it touches and no others."""

from __future__ import annotations

import functools
import json
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import explore

#: Bits of a coordinate in a Z-order code, and rows of a tile, about.
BITS, TILE_ROWS = 16, 200_000


def _spread_bits(v: Column) -> Column:
    """The low 16 bits of `v` with a zero between each two."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def interleave(x: int, y: int) -> int:
    """The Z-order code of whole coordinates, y in the higher bits."""
    return sum(((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1) for b in range(BITS))


@dataclass(frozen=True)
class Box:
    """The bounds of a layout and the number of bits of a tile's code."""

    min_x: float
    max_x: float
    min_y: float
    max_y: float
    tile_bits: int

    def place(self, value: float, axis: str) -> int:
        """The whole coordinate of a value, held within the box."""
        low, high = (self.min_x, self.max_x) if axis == "x" else (self.min_y, self.max_y)
        share = (value - low) / (high - low) if high > low else 0.0
        return min(max(math.floor(share * (1 << BITS)), 0), (1 << BITS) - 1)

    def code(self) -> Column:
        def whole(c, low, high):
            share = (F.col(c) - F.lit(low)) / F.lit(high - low) if high > low else F.lit(0.0)
            return F.least(F.greatest(F.floor(share * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1))

        return _spread_bits(whole("x", self.min_x, self.max_x)).bitwiseOR(F.shiftleft(_spread_bits(whole("y", self.min_y, self.max_y)), 1))


def write_tiles(points: DataFrame, path: str, tile_rows: int = TILE_ROWS) -> Box:
    """Store the finite points below `path` by tile, in Z-order within a file; a crowded tile gets several files. `open_tiles` reads them."""
    points = explore.finite_points(points)
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*").alias("n")).first()
    bits = 2 * min(6, max(0, math.ceil(math.log(max(b["n"], 1) / tile_rows, 4)))) if b["n"] else 0
    box = Box(*((0.0 if v is None else float(v)) for v in b[:4]), bits)
    files = max(1, math.ceil(b["n"] / tile_rows))
    coded = points.withColumn("code", box.code())
    coded = coded.withColumn("tile", F.shiftright("code", 2 * BITS - bits).cast("int") if bits else F.lit(0))
    coded.repartitionByRange(files, "code", *[c for c in points.columns if c not in ("x", "y")][:1]).sortWithinPartitions("tile", "code").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/points")
    points.sparkSession.createDataFrame([(json.dumps(box.__dict__),)], "box string").coalesce(1).write.mode("overwrite").text(f"{path}/box")
    return box


def open_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, Box]:
    return spark.read.parquet(f"{path}/points"), Box(**json.loads(spark.read.text(f"{path}/box").first()[0]))


def code_ranges(box: Box, left: float, right: float, low: float, high: float, most: int = 64) -> list[tuple[int, int]]:
    """Z-order ranges (first, last) that together cover the rectangle, in order; where it takes more than `most`, quadrants count whole."""
    x0, x1, y0, y1 = box.place(left, "x"), box.place(right, "x"), box.place(low, "y"), box.place(high, "y")
    if right < box.min_x or left > box.max_x or high < box.min_y or low > box.max_y:
        return []
    found, level = [(0, 0, BITS, False)], BITS
    while level:  # split what is only partly within, level by level, as long as the ranges are few
        split = []
        for x, y, size, whole in found:
            if whole:
                split.append((x, y, size, True))
                continue
            half = 1 << (size - 1)
            for qy in (y, y + half):
                for qx in (x, x + half):
                    if qx <= x1 and qx + half > x0 and qy <= y1 and qy + half > y0:
                        split.append((qx, qy, size - 1, x0 <= qx and qx + half - 1 <= x1 and y0 <= qy and qy + half - 1 <= y1))
        if len(split) > most:
            break
        found, level = split, level - 1
    ranges: list[tuple[int, int]] = []
    for first, last in sorted((interleave(x, y), interleave(x, y) + (1 << 2 * size) - 1) for x, y, size, _ in found):
        if ranges and ranges[-1][1] + 1 == first:
            ranges[-1] = (ranges[-1][0], last)
        else:
            ranges.append((first, last))
    return ranges


def within(tiles: DataFrame, box: Box, left: float, right: float, low: float, high: float) -> DataFrame:
    """The points of a rectangle, its edges included: only its tiles' files are opened, and only row groups whose codes it meets are read."""
    ranges = code_ranges(box, left, right, low, high)
    if not ranges:
        return tiles.filter("false").drop("code", "tile")
    shift = 2 * BITS - box.tile_bits
    tile_ranges = [(a >> shift, b >> shift) for a, b in ranges]
    return tiles.filter(_in_any("tile", tile_ranges)).filter(_in_any("code", ranges)).filter(F.col("x").between(left, right) & F.col("y").between(low, high)).drop("code", "tile")


def _in_any(column: str, ranges: list[tuple[int, int]]) -> Column:
    return functools.reduce(operator.or_, (F.col(column).between(a, b) for a, b in ranges))


def data_rectangle(box: Box, view: explore.Viewport, left: float, right: float, top: float, bottom: float) -> tuple[float, float, float, float]:
    """(left, right, low, high) in data coordinates of a rectangle on the screen, a little wider for rounding: `explore.project` undone."""
    def undo_x(px):
        x = (px - view.pan_x - view.width / 2) / view.zoom + view.width / 2
        span = (box.max_x - box.min_x) or 1.0
        return (x - explore.LEFT) / (view.width - 2 * explore.LEFT) * span * (1 + 2 * explore.PAD) - span * explore.PAD + box.min_x

    def undo_y(py):
        y = (py - view.pan_y - view.height / 2) / view.zoom + view.height / 2
        span = (box.max_y - box.min_y) or 1.0
        return (view.height - explore.BOTTOM - y) / (view.height - 2 * explore.BOTTOM + 2) * span * (1 + 2 * explore.PAD) - span * explore.PAD + box.min_y

    slack_x, slack_y = (1e-9 * max(abs(a), abs(b), 1e-300) for a, b in ((box.min_x, box.max_x), (box.min_y, box.max_y)))
    return undo_x(left) - slack_x, undo_x(right) + slack_x, undo_y(bottom) - slack_y, undo_y(top) + slack_y


def _projected(rows: DataFrame, box: Box, view: explore.Viewport) -> DataFrame:
    return explore.project_within(rows, view, box.min_x, box.max_x, box.min_y, box.max_y)


def cull(tiles: DataFrame, box: Box, view: explore.Viewport, thumbnails: bool) -> DataFrame:
    """What `explore.cull` of all projected points gives, from the tiles of the view."""
    m = (view.thumb_size if thumbnails else 2 * view.point_size) + 24
    near = within(tiles, box, *data_rectangle(box, view, -m, view.width + m, -m, view.height + m))
    return explore.cull(_projected(near, box, view), view, thumbnails)


def hover(tiles: DataFrame, box: Box, x: float, y: float, view: explore.Viewport, key: str) -> DataFrame:
    """What `explore.hover` of all projected points gives, from the tiles about the pointer."""
    r = max(22.0, 0.55 * view.thumb_size)
    near = within(tiles, box, *data_rectangle(box, view, x - r, x + r, y - r, y + r))
    return explore.hover(_projected(near, box, view), x, y, view, key)
