"""Published cell values as text, and the ids of grid squares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of official tables. A nil dash means zero, an unknown marker means missing.
NIL = ("-", "–", "—")
UNKNOWN = ("", ".", "..", "...", "…", "/", "x", "X", "k.A.", "k. A.")
NUMERAL = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
GRID_ID = r"^CRS3035RES([0-9]+)mN([0-9]+)E([0-9]+)$"


def parse_value(raw: Column, missing: tuple[str, ...] = ()) -> Column:
    """Text -> double. Markers of the release outrank nil dashes; what is no plain numeral, unknown markers too, is NULL."""
    text = F.trim(raw)
    plain = F.replace(text, F.lit(","), F.lit("."))
    value = F.when(plain.rlike(NUMERAL), plain.try_cast("double")).when(text.isin(*NIL), F.lit(0.0))
    return F.when(text.isin(*missing), None).otherwise(value) if missing else value


def is_nil(raw: Column) -> Column:
    return F.trim(raw).isin(*NIL)


def parse_grid_id(text: Column, strict: bool = False) -> Column:
    """struct(resolution_m, north, east) of the lower left corner; NULL, or an error if ``strict``, for other text."""
    part = lambda i: F.regexp_extract(text, GRID_ID, i).cast("long")
    found = F.when(text.rlike(GRID_ID), F.struct(part(1).cast("int").alias("resolution_m"), part(2).alias("north"), part(3).alias("east")))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no grid id: "), text))) if strict else found


def grid_centroid(grid: Column) -> tuple[Column, Column]:
    """(x, y) of the middle of a square."""
    half = grid["resolution_m"] / 2
    return grid["east"] + half, grid["north"] + half


def usable_coordinates(x: Column, y: Column) -> Column:
    """Neither missing nor zero."""
    return F.coalesce((x != 0) & (y != 0), F.lit(False))
