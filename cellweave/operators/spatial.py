"""Spatial joins: rings, reach, neighbours, covers and borders. All are equi joins on bins, never all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import cells
from cellweave.sources.shared import stored_in_ranges

# Kilometres of a degree of latitude in distances and in claims, reach of a place by tier, and how far "near" goes.
KM_PER_DEGREE, KM_PER_DEGREE_CLAIM = 111.32, 111.13
CLAIM_KM, NEAR_FACTOR = {1: 22.0, 2: 14.0, 3: 9.0}, 1.8
CITY_RADIUS_KM, BELL_KM = 22.0, 26.0


def ring_edges(rings: DataFrame) -> DataFrame:
    """(region, ring, x, y, pos) corners, closed or not -> (region, ring, x1, y1, x2, y2)."""
    whole = rings.groupBy("region", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    n = F.size("p")
    pair = F.transform("p", lambda a, i: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), F.get("p", (i + 1) % n)["x"].alias("x2"), F.get("p", (i + 1) % n)["y"].alias("y2")))
    return whole.select("region", "ring", F.explode(pair).alias("e")).select("region", "ring", "e.*")


#: Grids of the index begin here, in sides, so that corners with round coordinates don't fall on their lines.
SHIFT = math.sqrt(0.5)


def line_crossings(edges: DataFrame, side: float, keep: list[str], shift: float = 0.0) -> DataFrame:
    """(keep, _r, _at): where edges (x1, y1, x2, y2) cross the horizontal lines y = (_r + shift) * side. A line through a corner counts the edge above it."""
    first, last = F.ceil(F.least("y1", "y2") / side - shift), F.ceil(F.greatest("y1", "y2") / side - shift) - 1
    rows = edges.filter(first <= last).withColumn("_r", F.explode(F.sequence(first, last)))
    at = (F.col("x2") - F.col("x1")) * ((F.col("_r") + shift) * side - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return rows.select(*keep, "_r", at.alias("_at"))


def inner_spans(found: Column) -> Column:
    """Sorted crossings of one line with closed rings -> the spans [a, b) in between that are inside, even-odd."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(found) / 2).cast("int") - 1)
    return F.when(F.size(found) >= 2, F.transform(pairs, lambda i: F.struct(F.get(found, i * 2).alias("a"), F.get(found, i * 2 + 1).alias("b")))).otherwise(F.array())


def cover_index(edges: DataFrame, groups: list[str], side: float) -> DataFrame:
    """Squares of a grid that closed rings touch or hold: (groups, _bx, _by, _corner, x1, y1, x2, y2).

    A row without edge says that the square's lower right corner is inside (even-odd over all rings of
    a group); corners come from the crossings of each grid line, sorted once. A row with an edge is a square on the border and an edge
    that passes it. A square is in no row where the group is not, so no key grows with the width of a region.
    """
    found = line_crossings(edges, side, groups, SHIFT).groupBy(*groups, "_r").agg(F.array_sort(F.collect_list("_at")).alias("_s"))
    spans = found.select(*groups, F.col("_r").alias("_by"), F.explode(inner_spans(F.col("_s"))).alias("_span"))
    first, last = F.ceil(F.col("_span.a") / side - SHIFT) - 1, F.ceil(F.col("_span.b") / side - SHIFT) - 2
    none = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    corners = spans.filter(first <= last).select(*groups, F.explode(F.sequence(first, last)).alias("_bx"), "_by", F.lit(1).alias("_corner"), *none)
    slack = side * 1e-9  # an edge on the side of a square belongs to the squares on both sides
    at = lambda c: F.floor(c / side - SHIFT)
    rows = edges.withColumn("_by", F.explode(F.sequence(at(F.least("y1", "y2") - slack), at(F.greatest("y1", "y2") + slack))))
    slope = (F.col("x2") - F.col("x1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1"))
    inside = lambda y: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
    ends = [F.coalesce(F.col("x1") + slope * (inside(y) - F.col("y1")), other) for y, other in (((F.col("_by") + SHIFT) * side, F.col("x1")), ((F.col("_by") + 1 + SHIFT) * side, F.col("x2")))]
    border = rows.withColumn("_bx", F.explode(F.sequence(at(F.least(*ends) - slack), at(F.greatest(*ends) + slack))))
    return corners.unionByName(border.select(*groups, "_bx", "_by", F.lit(0).alias("_corner"), "x1", "y1", "x2", "y2"))


def held(points: DataFrame, index: DataFrame, key: str, groups: list[str], x: str, y: str, side: float) -> DataFrame:
    """(key, groups) of points inside, from the index alone, joined by square.

    From a point one way leads right to the side of its square and down to its corner. The
    point is inside if the corner and the edges crossed on the way, all of its own square, add up to an odd number.
    """
    own = points.select(key, F.col(x).alias("_px"), F.col(y).alias("_py"), F.floor(F.col(x) / side - SHIFT).alias("_bx"), F.floor(F.col(y) / side - SHIFT).alias("_by"))
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("_px", "_py", "x1", "y1", "x2", "y2"))
    right, low = (F.col("_bx") + 1 + SHIFT) * side, (F.col("_by") + SHIFT) * side
    at_y = (x2 - x1) * (py - y1) / F.when(y2 != y1, y2 - y1) + x1
    at_x = (y2 - y1) * (right - x1) / F.when(x2 != x1, x2 - x1) + y1
    across = ((y1 > py) != (y2 > py)) & (px < at_y) & (at_y <= right)
    down = ((x1 > right) != (x2 > right)) & (at_x > low) & (at_x <= py)
    met = F.col("_corner") + F.coalesce(across.cast("int"), F.lit(0)) + F.coalesce(down.cast("int"), F.lit(0))
    sums = own.join(index, ["_bx", "_by"]).groupBy(key, *groups).agg(F.sum(met).alias("_n"))
    return sums.filter("_n % 2 = 1").select(key, *groups)


def clip_to_rings(points: DataFrame, edges: DataFrame, key: str, x: str = "lon", y: str = "lat", side: float = 0.1) -> DataFrame:
    """Points inside any ring; holes are rings like others here. Squares of ``side`` serve as index."""
    rings = ["region", "ring"]
    inside = held(points, cover_index(edges, rings, side), key, rings, x, y, side).select(key).distinct()
    return points.join(inside, key, "left_semi")


def mask_region(points: DataFrame, edges: DataFrame, key: str, x: str = "lon", y: str = "lat", side: float = 0.1, name: str = "inside") -> DataFrame:
    """Even-odd over all rings together, so a hole subtracts; a point without place is not inside."""
    inside = held(points, cover_index(edges, [], side), key, [], x, y, side).withColumn(name, F.lit(True))
    return points.join(inside, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def within_km(lon: Column, lat: Column, at_lon: float, at_lat: float, km: float = CITY_RADIUS_KM) -> Column:
    kx = math.cos(math.radians(at_lat)) * KM_PER_DEGREE
    return F.pow((lon - at_lon) * kx, 2) + F.pow((lat - at_lat) * KM_PER_DEGREE, 2) <= km * km


def city_bounds(lon: Column, lat: Column, km: float = CITY_RADIUS_KM) -> tuple[Column, Column, Column, Column]:
    d_lat = F.lit(km / KM_PER_DEGREE)
    d_lon = d_lat / F.cos(F.radians(lat))
    return lon - d_lon, lat - d_lat, lon + d_lon, lat + d_lat


def near_bins(places: DataFrame, reach: Column, lon: str, lat: str, side: float) -> DataFrame:
    """Places once for each square of ``side`` degrees that their reach in km touches."""
    d_lat = reach / KM_PER_DEGREE_CLAIM
    d_lon = reach / (F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col(lat)) + d_lat))) * KM_PER_DEGREE_CLAIM)
    at = lambda c: F.floor(c / side)
    out = places.withColumn("_bx", F.explode(F.sequence(at(F.col(lon) - d_lon), at(F.col(lon) + d_lon))))
    return out.withColumn("_by", F.explode(F.sequence(at(F.col(lat) - d_lat), at(F.col(lat) + d_lat))))


def binned(points: DataFrame, lon: str, lat: str, side: float) -> DataFrame:
    return points.withColumn("_bx", F.floor(F.col(lon) / side)).withColumn("_by", F.floor(F.col(lat) / side))


def nearest_place(points: DataFrame, places: DataFrame, key: str, side: float = 0.5, max_broadcast: int = 50_000) -> DataFrame:
    """(key, name, near): smallest distance in shares of the place's reach, up to ``NEAR_FACTOR`` of it; the earlier place wins ties.

    Up to ``max_broadcast`` places travel to the points; more meet them by bin in a shuffle.
    """
    claim = F.when(F.col("tier") == 1, CLAIM_KM[1]).when(F.col("tier") == 2, CLAIM_KM[2]).otherwise(CLAIM_KM[3])
    places = places.select("ord", "name", F.col("lon").alias("_plon"), F.col("lat").alias("_plat"), claim.alias("_claim"))
    spread = near_bins(places, F.col("_claim") * NEAR_FACTOR, "_plon", "_plat", side)
    few = places.limit(max_broadcast + 1).count() <= max_broadcast
    found = binned(points, "lon", "lat", side).join(F.broadcast(spread) if few else spread, ["_bx", "_by"])
    dx = (F.col("_plon") - F.col("lon")) * F.cos(F.radians("lat")) * KM_PER_DEGREE
    ratio = F.sqrt(F.pow(dx, 2) + F.pow((F.col("_plat") - F.col("lat")) * KM_PER_DEGREE_CLAIM, 2)) / F.col("_claim")
    found = found.withColumn("_ratio", ratio).filter(F.col("_ratio") <= NEAR_FACTOR)
    best = found.groupBy(key).agg(F.min_by(F.struct("name", "_ratio"), F.struct("_ratio", "ord")).alias("b"))
    return best.select(key, "b.name", (F.col("b._ratio") > 1).alias("near"))


def kernel_density(points: DataFrame, places: DataFrame, key: str, reach_km: float = 260.0, side: float = 2.0) -> DataFrame:
    """(key, density): bells around places, wider and higher for lower tiers.

    ``reach_km`` is ten standard deviations of the widest bell, beyond which a bell adds less than 1e-21.
    """
    places = places.select("tier", F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    found = binned(points, "lon", "lat", side).join(near_bins(places, F.lit(reach_km), "_plon", "_plat", side), ["_bx", "_by"])
    dx = (F.col("lon") - F.col("_plon")) * KM_PER_DEGREE * F.cos(F.radians("lat"))
    dy = (F.col("lat") - F.col("_plat")) * KM_PER_DEGREE
    reach = F.lit(BELL_KM) / F.col("tier")
    sums = found.groupBy(key).agg(F.sum(F.exp(-(dx * dx + dy * dy) / (reach * reach * 2)) / F.col("tier")).alias("density"))
    return points.select(key).join(sums, key, "left").select(key, F.coalesce("density", F.lit(0.0)).alias("density"))


def neighbour_shade(points: DataFrame, key: str, height: str, radius: float, full: float) -> DataFrame:
    """(key, shade): mean of the capped rises of all others in the 3 x 3 bins around; 0 without neighbours.

    Keys are unique. Equal heights of a bin are counted first and asked about once. What lies around a bin is written once, in ranges of (bin, height)
    that Spark samples; counts and sums run inside the ranges and then over them, and every height reads them at itself
    and one full rise above, so a dense bin costs no pairs and is many tasks' work. A missing height is no rise.
    """
    low = points.agg(F.min("lon").alias("_lon0"), F.min("lat").alias("_lat0"))
    place = ("_c", "_l", "_h")
    own = points.join(F.broadcast(low)).select(key, F.floor((F.col("lon") - F.col("_lon0")) / radius).alias("_c"), F.floor((F.col("lat") - F.col("_lat0")) / radius).alias("_l"), F.col(height).cast("double").alias("_h"))
    spots = own.filter("_c is not null and _l is not null").groupBy(*place).agg(F.count("*").alias("_m"))
    away = lambda: F.explode(F.array([F.lit(i) for i in (-1, 0, 1)]))
    others = spots.withColumn("_i", away()).withColumn("_j", away()).select(
        (F.col("_c") + F.col("_i")).alias("_c"), (F.col("_l") + F.col("_j")).alias("_l"), F.lit(None).cast("double").alias("_h"),
        F.lit(-1).alias("_ask"), F.coalesce("_h", F.lit(float("-inf"))).alias("_at"), F.col("_m").alias("_n"), (F.coalesce("_h", F.lit(0.0)) * F.col("_m")).alias("_s"),
    )
    asks = F.posexplode(F.array(F.col("_h"), F.col("_h") + full, F.lit(float("inf")))).alias("_ask", "_at")
    asked = spots.filter("_h is not null").select(*place, asks).withColumns({"_n": F.lit(0).cast("long"), "_s": F.lit(0.0)})
    rows = stored_in_ranges(others.unionByName(asked), "_c", "_l", "_at")
    bins = ["_c", "_l", "_r"]
    before = Window.partitionBy("_c", "_l").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.groupBy(*bins).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    below = below.select(*bins, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_below{c}") for c in ("_n", "_s")])
    inside = Window.partitionBy(*bins).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({c: F.sum(c).over(inside) for c in ("_n", "_s")}).filter("_ask >= 0").join(below, bins)
    n, s = ([F.max(F.when(F.col("_ask") == a, F.col(c) + F.col(f"_below{c}"))) for a in (0, 1, 2)] for c in ("_n", "_s"))
    read = rows.groupBy(*place).agg(*[c.alias(f"_n{a}") for a, c in enumerate(n)], *[c.alias(f"_s{a}") for a, c in enumerate(s)])
    partly = (F.col("_s1") - F.col("_s0") - F.col("_h") * (F.col("_n1") - F.col("_n0"))) / full
    shade = F.when(F.col("_n2") > 1, (F.col("_n2") - F.col("_n1") + partly) / (F.col("_n2") - 1))
    return own.join(read.select(*place, shade.alias("shade")), list(place), "left").select(key, F.coalesce("shade", F.lit(0.0)).alias("shade"))


def polygon_cover(polygons: DataFrame, res: int, rings: str = "rings") -> DataFrame:
    """Each polygon part with each cell of the lattice whose centre lies in it, even-odd over its closed rings.

    Scanline fill: each edge crosses the rows of the lattice between its ends, the crossings of a row are sorted once and
    the spans between them are cut into cells, so the cost goes by crossings and cells, not by edges times cells. Rows of a large part are dealt over tasks.
    Parts are told apart by their columns and a hash of their rings; equal rows, however many, are filled once and counted.
    An outer ring of fewer than four points covers nothing.
    """
    a = cells.EDGE_METRES[res]
    wide, high = a * cells.ROOT3, a * 1.5
    keep = [c for c in polygons.columns if c != rings]
    edge = lambda ring: F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"), F.get(ring, i + 1)["x"].alias("x2"), F.get(ring, i + 1)["y"].alias("y2")))
    parts = polygons.filter(F.size(F.get(rings, F.lit(0))) >= 4).withColumn("_k", F.xxhash64(rings))
    edges = parts.select(*keep, "_k", F.explode(rings).alias("_ring")).filter(F.size("_ring") >= 2).select(*keep, "_k", F.posexplode(edge(F.col("_ring"))).alias("_i", "_e"))
    edges = edges.select(*keep, "_k", F.struct(F.col("_i"), F.xxhash64("_e")).alias("_id"), "_e.*")
    found = line_crossings(edges, high, [*keep, "_k", "_id"]).groupBy(*keep, "_k", "_r").agg(F.sort_array(F.collect_set(F.struct("_at", "_id"))).alias("_s"), F.count("*").alias("_all"))
    spans = found.select(*keep, "_r", F.floor(F.col("_all") / F.size("_s")).cast("int").alias("_copies"), F.explode(inner_spans(F.transform("_s", lambda c: c["_at"]))).alias("_span"))
    q = lambda x: x / wide - F.col("_r") / 2
    rows = spans.withColumn("_q", F.explode(F.sequence(F.floor(q(F.col("_span.a"))), F.ceil(q(F.col("_span.b"))))))
    x = (F.col("_q") + F.col("_r") / 2) * wide
    rows = rows.filter((x >= F.col("_span.a")) & (x < F.col("_span.b")))
    return rows.select(*keep, cells.pack(res, F.col("_q"), F.col("_r")).alias("cell"), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_")).drop("_")


def border_edges(edges: DataFrame, decimals: int = 5) -> DataFrame:
    """Undirected edges that occur once over all areas: (ax, ay, bx, by)."""
    a, b = (F.struct(F.round(f"x{i}", decimals).alias("x"), F.round(f"y{i}", decimals).alias("y")) for i in (1, 2))
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b")
    once = ends.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 1")
    return once.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def boxes_in_view(boxes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Boxes that touch a view, edges included."""
    return boxes.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))


def nearest_boxes(boxes: DataFrame, lon: float, lat: float, n: int = 300) -> DataFrame:
    """The n boxes whose centres are nearest to a point, by squared degrees with longitude scaled."""
    kx = math.cos(math.radians(lat))
    dx, dy = ((F.col("west") + F.col("east")) / 2 - lon) * kx, (F.col("south") + F.col("north")) / 2 - lat
    return boxes.withColumn("dist2", dx * dx + dy * dy).orderBy("dist2", "tile").limit(n)
