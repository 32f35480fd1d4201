"""Raster pixels: where they lie, which are usable, and what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 10-degree tiles of 2400 x 2400 pixels (15 arc-seconds), numbered from the north-west corner of the world.
PIXEL_DEGREES, TILE_DEGREES = 10.0 / 2400, 10
GOOD_QUALITY = (0, 2)


def pixel_value(raw: Column, fill: float, scale: float = 1.0, offset: float = 0.0) -> Column:
    """The fill value (within tolerance) is missing; else raw * scale + offset."""
    return F.when(F.abs(raw - fill) > 1e-8 + 1e-5 * abs(fill), raw * scale + offset)


def tile_origin(tile: Column) -> tuple[Column, Column]:
    """(west, north) of a tile named hHHvVV."""
    part = lambda i: F.regexp_extract(tile, r"h(\d\d)v(\d\d)", i).cast("int")
    return part(1) * TILE_DEGREES - 180, 90 - part(2) * TILE_DEGREES


def pixel_centre(tile: Column, r: Column, c: Column) -> tuple[Column, Column]:
    """(lon, lat)."""
    west, north = tile_origin(tile)
    return west + (c + 0.5) * PIXEL_DEGREES, north - (r + 0.5) * PIXEL_DEGREES


def ascii_cell_centre(r: Column, c: Column, xll: Column, yll: Column, rows: Column, size: Column) -> tuple[Column, Column]:
    return xll + (c + 0.5) * size, yll + (rows - r - 0.5) * size


def tiles_for_bbox(boxes: DataFrame) -> DataFrame:
    """Each tile that a box (west, south, east, north) touches, both ends included."""
    at = lambda a: F.floor(F.col(a) / TILE_DEGREES).cast("int")
    out = boxes.withColumn("_h", F.explode(F.sequence(at("west") + 18, at("east") + 18))).withColumn("_b", F.explode(F.sequence(at("south"), at("north"))))
    name = F.format_string("h%02dv%02d", F.col("_h"), F.lit(8) - F.col("_b"))
    return out.withColumn("tile", name).drop("_h", "_b")


def quality_mask(value: Column, quality: Column, good: tuple[int, ...] = GOOD_QUALITY) -> Column:
    return value.isNotNull() & quality.isin(*good)


def floor_clamp(value: Column, floor: float) -> Column:
    """At or below the floor: zero, and the row stays. For values that are present."""
    return F.when(value > floor, value).otherwise(0.0)


def floor_drop(rows: DataFrame, value: str, floor: float) -> DataFrame:
    """At or below the floor: the row goes."""
    return rows.filter(F.col(value) > floor)


def luma(bands: list[Column]) -> Column:
    """Brightness of three bands; the first one, if there are fewer."""
    return bands[0] * 0.2126 + bands[1] * 0.7152 + bands[2] * 0.0722 if len(bands) >= 3 else bands[0]


def in_box(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    """All four sides included."""
    return x.between(west, east) & y.between(south, north)
