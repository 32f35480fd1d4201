"""Queries of pixels, units, spatial joins, series and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import cells, crs, pixels, units
from cellweave.operators import raster, series
from cellweave.operators import spatial as sp
from cellweave.plans.registry import query


# --- pixels


@query("scan_pixels", "SELECT step, tile, count(v) AS present, count(*) - count(v) AS missing, round(sum(v), 4) AS total FROM (SELECT step, tile, CASE WHEN raw <> -999 THEN raw * 0.5 + 1 END AS v FROM <pixels>) GROUP BY step, tile")
def scan_pixels(t):  # noqa: ANN001, ANN201
    p = t("pixels").withColumn("v", pixels.pixel_value(F.col("raw"), -999, 0.5, 1.0))
    return p.groupBy("step", "tile").agg(F.count("v").alias("present"), (F.count("*") - F.count("v")).alias("missing"), F.round(F.sum("v"), 4).alias("total"))


@query("pixel_centre", "SELECT DISTINCT tile, r, c, round(0 + (c + 0.5) * (10.0::DOUBLE / 2400), 9) AS lon, round(CASE tile WHEN 'h18v03' THEN 60 ELSE 50 END - (r + 0.5) * (10.0::DOUBLE / 2400), 9) AS lat FROM <pixels>")
def pixel_centre(t):  # noqa: ANN001, ANN201
    lon, lat = pixels.pixel_centre(F.col("tile"), F.col("r"), F.col("c"))
    return t("pixels").select("tile", "r", "c").distinct().select("tile", "r", "c", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("tiles_for_bbox", "SELECT ord, 'h' || (h + 18) || 'v0' || (8 - v) AS tile FROM (SELECT ord, unnest(generate_series(floor(lon / 10)::BIGINT, floor((lon + 5) / 10)::BIGINT)) AS h, lat FROM <places>), unnest(generate_series(floor((lat - 2) / 10)::BIGINT, floor((lat + 2) / 10)::BIGINT)) AS u(v)")
def tiles_for_bbox(t):  # noqa: ANN001, ANN201
    box = t("places").select("ord", F.col("lon").alias("west"), (F.col("lat") - 2).alias("south"), (F.col("lon") + 5).alias("east"), (F.col("lat") + 2).alias("north"))
    return pixels.tiles_for_bbox(box).select("ord", "tile")


@query("ascii_cell_centre", "SELECT DISTINCT r, c, 3280000.0::DOUBLE + (c + 0.5) * 1000 AS x, 5237000.0::DOUBLE + (2400 - r - 0.5) * 1000 AS y FROM <pixels>")
def ascii_cell_centre(t):  # noqa: ANN001, ANN201
    x, y = pixels.ascii_cell_centre(F.col("r"), F.col("c"), F.lit(3280000.0), F.lit(5237000.0), F.lit(2400), F.lit(1000))
    return t("pixels").select("r", "c").distinct().select("r", "c", x.cast("double").alias("x"), y.cast("double").alias("y"))


@query("quality_mask", "SELECT step, count(*) AS kept FROM <pixels> WHERE raw <> -999 AND quality IN (0, 2) GROUP BY step")
def quality_mask(t):  # noqa: ANN001, ANN201
    v = pixels.pixel_value(F.col("raw"), -999)
    return t("pixels").filter(pixels.quality_mask(v, F.col("quality"))).groupBy("step").agg(F.count("*").alias("kept"))


@query("floor_clamp", "SELECT step, count(*) AS rows, sum(CASE WHEN raw > 30000 THEN raw ELSE 0 END)::DOUBLE AS total FROM <pixels> WHERE raw <> -999 GROUP BY step")
def floor_clamp(t):  # noqa: ANN001, ANN201
    p = t("pixels").withColumn("v", pixels.pixel_value(F.col("raw"), -999)).filter("v is not null")
    return p.groupBy("step").agg(F.count("*").alias("rows"), F.sum(pixels.floor_clamp(F.col("v"), 30000)).alias("total"))


@query("floor_drop", "SELECT step, count(*) AS rows FROM <pixels> WHERE raw > 30000 GROUP BY step")
def floor_drop(t):  # noqa: ANN001, ANN201
    return pixels.floor_drop(t("pixels"), "raw", 30000).groupBy("step").agg(F.count("*").alias("rows"))


@query("luma", "SELECT quality, round(sum(0.2126::DOUBLE * (raw % 256) + 0.7152::DOUBLE * (r % 256) + 0.0722::DOUBLE * (c % 256)), 3) AS three, sum(raw % 256)::BIGINT AS one FROM <pixels> WHERE raw >= 0 GROUP BY quality")
def luma(t):  # noqa: ANN001, ANN201
    bands = [F.col(b) % 256 for b in ("raw", "r", "c")]
    return t("pixels").filter("raw >= 0").groupBy("quality").agg(F.round(F.sum(pixels.luma(bands)), 3).alias("three"), F.sum(pixels.luma(bands[:1])).alias("one"))


@query("latest_granule", "SELECT substr(name, 10, 4) AS year, substr(name, 18, 6) AS tile, max(name) AS name FROM <files> WHERE name LIKE '%.h5' GROUP BY 1, 2")
def latest_granule(t):  # noqa: ANN001, ANN201
    part = lambda i: F.regexp_extract("name", r"\.A(\d{4})\d{3}\.(h\d\dv\d\d)\.", i)
    files = t("files").filter(F.col("name").endswith(".h5")).withColumns({"year": part(1), "tile": part(2)})
    return raster.latest_granule(files, ["year", "tile"])


@query("check_same_grid", "SELECT layer, height, width, height = 60 AND width = 60 AS same FROM (SELECT layer, max(r) + 1 AS height, max(c) + 1 AS width FROM (SELECT 'mask' AS layer, r, c FROM <forest_pixels> UNION ALL SELECT 'latest', r, c FROM <forest_pixels> UNION ALL SELECT 'agent', r, c FROM <forest_pixels> WHERE r < 59) GROUP BY layer)")
def check_same_grid(t):  # noqa: ANN001, ANN201
    p = t("forest_pixels").select("r", "c")
    layers = p.withColumn("layer", F.lit("mask")).union(p.withColumn("layer", F.lit("latest"))).union(p.filter("r < 59").withColumn("layer", F.lit("agent")))
    return raster.check_same_grid(layers)


def flags():  # noqa: ANN201
    forest, disturbed = F.col("mask") == 1, (F.col("mask") == 1) & (F.col("latest") > 0)
    return {"forest": forest, "disturbed": disturbed} | {f"agent{k}": disturbed & (F.col("agent") == k) for k in range(1, 5)}


AGENTS = [f"agent{k}" for k in range(1, 5)]
BLOCKS = "(SELECT r // 2 AS br, c // 2 AS bc, sum((mask = 1)::INT)::BIGINT AS forest, sum((mask = 1 AND latest > 0)::INT)::BIGINT AS disturbed, " + ", ".join(f"sum((mask = 1 AND latest > 0 AND agent = {k})::INT)::BIGINT AS agent{k}" for k in range(1, 5)) + " FROM <forest_pixels> GROUP BY 1, 2 HAVING count(*) = 4 AND sum((mask = 1)::INT) > 0)"


@query("block_reduce", f"SELECT br, bc, br * 2 + 1.0::DOUBLE AS r_centre, bc * 2 + 1.0::DOUBLE AS c_centre, forest, disturbed, agent1, agent2, agent3, agent4 FROM {BLOCKS}")
def block_reduce(t):  # noqa: ANN001, ANN201
    return raster.block_reduce(t("forest_pixels"), 2, flags(), "forest")


@query("forest_metrics", f"""SELECT br, bc, round(least(1.0, forest * 0.0009::DOUBLE / 0.01), 6) AS forest_share, round(least(1.0, disturbed::DOUBLE / forest), 6) AS disturbed_share,
CASE WHEN k > 0 THEN CASE greatest(agent1, agent2, agent3, agent4) WHEN agent1 THEN 0 WHEN agent2 THEN 1 WHEN agent3 THEN 2 ELSE 3 END END::DOUBLE AS agent,
CASE WHEN k > 0 THEN round(greatest(agent1, agent2, agent3, agent4)::DOUBLE / k, 6) END AS dominance FROM (SELECT *, agent1 + agent2 + agent3 + agent4 AS k FROM {BLOCKS})""")
def forest_metrics(t):  # noqa: ANN001, ANN201
    out = raster.forest_metrics(raster.block_reduce(t("forest_pixels"), 2, flags(), "forest"), AGENTS, 0.01)
    return out.select("br", "bc", F.round("forest_share", 6).alias("forest_share"), F.round("disturbed_share", 6).alias("disturbed_share"), F.col("agent").cast("double").alias("agent"), F.round("dominance", 6).alias("dominance"))


# --- units

USABLE = "(SELECT * FROM <units> WHERE lon IS NOT NULL AND kw IS NOT NULL)"
STANDS = "status IN (35, 37, 38) AND NOT (status = 38 AND decommissioned IS NULL) AND extract(year FROM commissioned) <= y AND NOT coalesce(extract(year FROM decommissioned) <= y, FALSE)"


@query("bbox_filter", "SELECT id FROM <units> WHERE lon BETWEEN 7 AND 10 AND lat BETWEEN 48 AND 52")
def bbox_filter(t):  # noqa: ANN001, ANN201
    return t("units").filter(pixels.in_box(F.col("lon"), F.col("lat"), 7, 48, 10, 52)).select("id")


@query("installed_in_year", f"SELECT id FROM (SELECT *, 1999 AS y FROM <units>) WHERE {STANDS}")
def installed_in_year(t):  # noqa: ANN001, ANN201
    return t("units").filter(units.installed_in_year(F.lit(1999), F.col("status"), F.col("commissioned"), F.col("decommissioned"))).select("id")


@query("onshore_filter", "SELECT status, count(*) AS units FROM <units> WHERE lage <> 889 GROUP BY status")
def onshore_filter(t):  # noqa: ANN001, ANN201
    return t("units").filter(units.onshore(F.col("lage"))).groupBy("status").agg(F.count("*").alias("units"))


YEARS = f"(SELECT id, lon, lat, kw, y AS year FROM {USABLE} AS u, (SELECT unnest(generate_series(1995, 2001)) AS y) WHERE {STANDS})"


@query("expand_years", f"SELECT id, year::INT AS year FROM {YEARS}")
def expand_years(t):  # noqa: ANN001, ANN201
    return units.expand_years(units.usable_units(t("units")), 1995, 2001).select("id", "year")


@query("pool_capacity", f"SELECT year::INT AS year, floor(lon)::BIGINT AS east, floor(lat)::BIGINT AS north, round(sum(kw / 1000), 6) AS mw FROM {YEARS} GROUP BY ALL")
def pool_capacity(t):  # noqa: ANN001, ANN201
    u = units.expand_years(units.usable_units(t("units")), 1995, 2001)
    return u.groupBy("year", F.floor("lon").alias("east"), F.floor("lat").alias("north")).agg(F.round(F.sum(F.col("kw") / 1000), 6).alias("mw"))


# --- projections

K, (E, QP, SERIES) = crs._laea(), crs._authalic(crs.GRS80[1])
D = lambda v: f"{v!r}::DOUBLE"


def laea_sql(source: str) -> str:
    """SQL that adds x, y in metres to lon, lat."""
    a = f"SELECT *, sin(radians(lat)) AS _s, radians(lon - 10.0) AS _l FROM {source}"
    b = f"SELECT *, (_s / (1 - _s * _s * {D(E * E)}) - ln((1 - _s * {D(E)}) / (1 + _s * {D(E)})) / {D(2 * E)}) * {D(1 - E * E)} / {D(QP)} AS _sb FROM ({a})"
    c = f"SELECT *, sqrt(1 - _sb * _sb) AS _cb FROM ({b})"
    d = f"SELECT *, sqrt(2.0 / (1 + _sb * {D(K['sin'])} + _cb * cos(_l) * {D(K['cos'])})) * {D(K['rq'])} AS _b FROM ({c})"
    return f"(SELECT * EXCLUDE (_s, _l, _sb, _cb, _b), 4321000.0 + _b * {D(K['d'])} * _cb * sin(_l) AS x, 3210000.0 + _b / {D(K['d'])} * (_sb * {D(K['cos'])} - _cb * cos(_l) * {D(K['sin'])}) AS y FROM ({d}))"


@query("reproject", f"SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat, TRUE AS tm_closes FROM {laea_sql('<points>')}")
def reproject(t):  # noqa: ANN001, ANN201
    """LAEA there and back, and transverse Mercator there and back to within a millimetre."""
    p = crs.to_laea(t("points").select("id", "lon", "lat"))
    p = crs.from_laea(p.withColumnsRenamed({"lon": "lon1", "lat": "lat1"}))
    p = crs.from_tm(crs.to_tm(p, crs.UTM32, x="tx", y="ty"), crs.UTM32, "tx", "ty", "lon2", "lat2")
    closes = (F.abs(F.col("lon2") - F.col("lon1")) < 1e-8) & (F.abs(F.col("lat2") - F.col("lat1")) < 1e-8)
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), closes.alias("tm_closes"))


@query("cell_centre", "SELECT id, TRUE AS near FROM <points>")
def cell_centre(t):  # noqa: ANN001, ANN201
    """A point's cell centre, back in degrees, lies within one edge of the point."""
    p = cells.with_cell(crs.to_laea(t("points")), "x", "y", 8)
    x, y = cells.centre(F.col("cell"), 8)
    p = crs.from_laea(p.withColumns({"cx": x, "cy": y}), "cx", "cy", "clon", "clat")
    p = p.withColumns({"clon": F.round("clon", 6), "clat": F.round("clat", 6)})
    return p.select("id", sp.within_km(F.col("clon") - F.col("lon"), F.col("clat") - F.col("lat"), 0, 0, 1.0).alias("near"))


# --- spatial joins

RINGS = {0: [(10.2, 50.1), (11.0, 50.1), (11.0, 50.9), (10.6, 50.4), (10.2, 50.9)], 1: [(10.5, 50.2), (10.8, 50.2), (10.8, 50.35), (10.5, 50.35)], 2: [(11.1, 51.0), (11.4, 51.0), (11.4, 51.3), (11.1, 51.3)]}
EDGES = "(VALUES " + ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, ring in RINGS.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ") AS e(ring, x1, y1, x2, y2)"
PARITY = f"(SELECT id, ring, count(*) AS n FROM <points> JOIN {EDGES} ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, ring)"


def region_edges(t):  # noqa: ANN001, ANN201
    corners = [("r", k, i, x, y) for k, ring in RINGS.items() for i, (x, y) in enumerate(ring)]
    inline = ", ".join(f"('{g}', {k}, {i}, {x}D, {y}D)" for g, k, i, x, y in corners)
    return sp.ring_edges(t("points").sparkSession.sql(f"SELECT * FROM VALUES {inline} AS c(region, ring, pos, x, y)"))


@query("clip_to_rings", f"SELECT id FROM {PARITY} WHERE n % 2 = 1 GROUP BY id")
def clip_to_rings(t):  # noqa: ANN001, ANN201
    return sp.clip_to_rings(t("points"), region_edges(t), "id").select("id")


@query("mask_region_polygon", f"SELECT p.id, coalesce(s.n % 2 = 1, FALSE) AS inside FROM <points> AS p LEFT JOIN (SELECT id, sum(n) AS n FROM {PARITY} GROUP BY id) s USING (id)".replace("<points> AS p", "(SELECT * FROM <points>) AS p"))
def mask_region_polygon(t):  # noqa: ANN001, ANN201
    return sp.mask_region(t("points"), region_edges(t), "id").select("id", "inside")


@query("mask_region_radius", "SELECT id, ((lon - 10.5) * cos(radians(50.5)) * 111.32) ^ 2 + ((lat - 50.5) * 111.32) ^ 2 <= 22 * 22 AS inside FROM <points>")
def mask_region_radius(t):  # noqa: ANN001, ANN201
    return t("points").select("id", sp.within_km(F.col("lon"), F.col("lat"), 10.5, 50.5).alias("inside"))


@query("city_bounds", "SELECT id, round(lon - 22 / 111.32 / cos(radians(lat)), 9) AS west, round(lat - 22 / 111.32::DOUBLE, 9) AS south, round(lon + 22 / 111.32 / cos(radians(lat)), 9) AS east, round(lat + 22 / 111.32::DOUBLE, 9) AS north FROM <points>")
def city_bounds(t):  # noqa: ANN001, ANN201
    sides = sp.city_bounds(F.col("lon"), F.col("lat"))
    return t("points").select("id", *[F.round(s, 9).alias(n) for s, n in zip(sides, ("west", "south", "east", "north"), strict=True)])


RATIO = "sqrt(((pl.lon - p.lon) * cos(radians(p.lat)) * 111.32) ^ 2 + ((pl.lat - p.lat) * 111.13) ^ 2) / CASE pl.tier WHEN 1 THEN 22 WHEN 2 THEN 14 ELSE 9 END"


@query("nearest_place", f"SELECT id, name, ratio > 1 AS near FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ratio, ord) AS k FROM (SELECT p.id, pl.name, pl.ord, {RATIO} AS ratio FROM (SELECT * FROM <points>) p, (SELECT * FROM <places>) pl) WHERE ratio <= 1.8) WHERE k = 1")
def nearest_place(t):  # noqa: ANN001, ANN201
    return sp.nearest_place(t("points"), t("places"), "id")


@query("kernel_density", "SELECT p.id, round(sum(exp(-(((p.lon - pl.lon) * 111.32 * cos(radians(p.lat))) ^ 2 + ((p.lat - pl.lat) * 111.32) ^ 2) / (2 * (26.0 / tier) ^ 2)) / tier), 9) AS density FROM (SELECT * FROM <points>) p, (SELECT * FROM <places>) pl GROUP BY p.id")
def kernel_density(t):  # noqa: ANN001, ANN201
    return sp.kernel_density(t("points"), t("places"), "id").select("id", F.round("density", 9).alias("density"))


SPOT = "(SELECT id, lon, lat, height, floor((lon - min(lon) OVER ()) / 0.01) AS c, floor((lat - min(lat) OVER ()) / 0.01) AS r FROM <points>)"


@query("neighbour_shade", f"SELECT a.id, round(coalesce(avg(least(1.0, greatest(0.0, (b.height - a.height) / 20000.0))), 0), 9) AS shade FROM {SPOT} a LEFT JOIN {SPOT} b ON abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1 AND a.id <> b.id GROUP BY a.id")
def neighbour_shade(t):  # noqa: ANN001, ANN201
    return sp.neighbour_shade(t("points"), "id", "height", 0.01, 20000.0).select("id", F.round("shade", 9).alias("shade"))


A10 = cells.EDGE_METRES[10]
WIDE, HIGH = A10 * cells.ROOT3, A10 * 1.5
PACK = f"({10 << cells.SHIFT} + q + {cells.BIAS}) * {1 << cells.SHIFT} + r + {cells.BIAS}"
LATTICE = f"(SELECT *, unnest(generate_series(floor(x0 / {D(WIDE)} - r / 2.0::DOUBLE)::BIGINT, ceil((x0 + side) / {D(WIDE)} - r / 2.0::DOUBLE)::BIGINT)) AS q FROM (SELECT *, unnest(generate_series(floor(y0 / {D(HIGH)})::BIGINT, ceil((y0 + side) / {D(HIGH)})::BIGINT)) AS r FROM <squares>))"
INSIDE = "x >= x0 AND x < x0 + side AND y >= y0 AND y < y0 + side"
HOLE = "x >= x0 + side / 4 AND x < x0 + side * 3 / 4 AND y >= y0 + side / 4 AND y < y0 + side * 3 / 4"
COVER = f"(SELECT id, code, {PACK} AS cell FROM (SELECT *, (q + r / 2.0::DOUBLE) * {D(WIDE)} AS x, r * {D(HIGH)} AS y FROM {LATTICE}) WHERE {INSIDE} AND NOT (hole AND {HOLE}))"


def square_polygons(t):  # noqa: ANN001, ANN201
    """Rings of the squares, closed."""
    corner = lambda a, b: F.array(*[F.struct((F.col("x0") + F.col("side") * (b if i else a)).alias("x"), (F.col("y0") + F.col("side") * (b if j else a)).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    rings = F.when(F.col("hole"), F.array(corner(0, 1), corner(0.25, 0.75))).otherwise(F.array(corner(0, 1)))
    return t("squares").select("id", "code", rings.alias("rings"))


@query("polygon_cover", f"SELECT id, cell FROM {COVER}")
def polygon_cover(t):  # noqa: ANN001, ANN201
    return sp.polygon_cover(square_polygons(t), 10).select("id", "cell")


@query("border_edges", "SELECT ax, ay, bx, \"by\" FROM (SELECT unnest([x0, x0 + side, x0, x0]) AS ax, unnest([y0, y0, y0 + side, y0]) AS ay, unnest([x0 + side, x0 + side, x0 + side, x0]) AS bx, unnest([y0, y0 + side, y0 + side, y0 + side]) AS \"by\" FROM <squares> WHERE NOT hole) GROUP BY ALL HAVING count(*) = 1")
def border_edges(t):  # noqa: ANN001, ANN201
    ring = square_polygons(t).filter(F.size("rings") == 1).select(F.get("rings", F.lit(0)).alias("p"))
    pair = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i)["x"].alias("x1"), F.get("p", i)["y"].alias("y1"), F.get("p", i + 1)["x"].alias("x2"), F.get("p", i + 1)["y"].alias("y2")))
    return sp.border_edges(ring.select(F.explode(pair).alias("e")).select("e.*"))


BOXES = "(SELECT 't' || floor(lon * 20)::BIGINT || '_' || floor(lat * 20)::BIGINT AS tile, count(*) AS n, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM <points> GROUP BY 1)"


def boxes(t):  # noqa: ANN001, ANN201
    tile = F.concat(F.lit("t"), F.floor(F.col("lon") * 20).cast("string"), F.lit("_"), F.floor(F.col("lat") * 20).cast("string"))
    return t("points").groupBy(tile.alias("tile")).agg(F.count("*").alias("n"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query("tiles_in_view", f"SELECT tile FROM {BOXES} WHERE west <= 10.9 AND east >= 10.3 AND south <= 50.8 AND north >= 50.2")
def tiles_in_view(t):  # noqa: ANN001, ANN201
    return sp.boxes_in_view(boxes(t), 10.3, 50.2, 10.9, 50.8).select("tile")


@query("nearest_tiles", f"SELECT tile, round(dist2, 9) AS dist2 FROM (SELECT *, (((west + east) / 2 - 10.6) * cos(radians(50.5))) ^ 2 + ((south + north) / 2 - 50.5) ^ 2 AS dist2 FROM {BOXES}) ORDER BY dist2, tile LIMIT 300")
def nearest_tiles(t):  # noqa: ANN001, ANN201
    return sp.nearest_boxes(boxes(t), 10.6, 50.5).select("tile", F.round("dist2", 9).alias("dist2"))


@query("round_bounds", "SELECT id % 3 AS tier, round(min(lon), 3) AS west, round(min(lat), 3) AS south, round(max(lon), 3) AS east, round(max(lat), 3) AS north FROM <points> GROUP BY 1")
def round_bounds(t):  # noqa: ANN001, ANN201
    ends = (("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))
    return t("points").groupBy((F.col("id") % 3).alias("tier")).agg(*[F.round(f(c), 3).alias(n) for n, f, c in ends])


# --- series

STEPS = "(SELECT step::INT AS step, r // 100 AS cell, sum(raw)::DOUBLE AS value FROM <pixels> WHERE raw <> -999 GROUP BY 1, 2)"


def by_step(t):  # noqa: ANN001, ANN201
    return t("pixels").filter("raw <> -999").groupBy(F.col("step").cast("int").alias("step"), F.floor(F.col("r") / 100).alias("cell")).agg(F.sum("raw").cast("double").alias("value"))


@query("yearly_delta", f"SELECT step, cell, value - lag(value) OVER (PARTITION BY cell ORDER BY step) AS delta FROM {STEPS}")
def yearly_delta(t):  # noqa: ANN001, ANN201
    return series.yearly_delta(by_step(t), ["cell"], "step", "value").select("step", "cell", "delta")


TWO = f"SELECT a.cell, a.value AS before, b.value AS now, {{}} FROM (SELECT * FROM {STEPS} WHERE step = 1998) a {{}} JOIN (SELECT * FROM {STEPS} WHERE step = 2000) b USING (cell)"


def two_steps(t):  # noqa: ANN001, ANN201
    s = by_step(t).withColumn("res", F.lit(8))
    return (s.filter(F.col("step") == y).drop("step") for y in (1998, 2000))


@query("change_pct", TWO.format("round(CASE WHEN a.value >= 100000 THEN (b.value - a.value) / a.value END, 9) AS change", ""))
def change_pct(t):  # noqa: ANN001, ANN201
    both = series.join_two_steps(*two_steps(t))
    return both.select("cell", "before", "now", F.round(series.change_pct(F.col("before"), F.col("now"), 100000), 9).alias("change"))


@query("join_two_steps", TWO.format("8 AS res", ""))
def join_two_steps(t):  # noqa: ANN001, ANN201
    return series.join_two_steps(*two_steps(t))


@query("relative_change", TWO.format("round(CASE WHEN a.value >= 100000 THEN (b.value - a.value) / a.value END, 9) AS change", "RIGHT").replace("SELECT a.cell", "SELECT cell"))
def relative_change(t):  # noqa: ANN001, ANN201
    out = series.relative_change(*two_steps(t), 100000)
    return out.select("cell", "before", "now", F.round("change", 9).alias("change"))


@query("last_step", f"SELECT cell, max(step) AS last_step FROM {STEPS} WHERE value > 500000 GROUP BY cell")
def last_step(t):  # noqa: ANN001, ANN201
    return series.last_step(by_step(t).filter("value > 500000"), "cell", "step")


@query("time_blend", f"SELECT cell, round(a + (b - a) * 0.4, 6) AS value FROM (SELECT cell, max(value) FILTER (step = 1997) AS a, max(value) FILTER (step = 1998) AS b FROM {STEPS} WHERE step IN (1997, 1998) GROUP BY cell)")
def time_blend(t):  # noqa: ANN001, ANN201
    out = series.blend_steps(by_step(t).withColumn("k", F.col("step") - 1995), ["cell"], "k", "value", 0.4, 7)
    return out.select("cell", F.round("value", 6).alias("value"))


PARTS = "(SELECT l_suppkey % 8 AS grp, l_partkey % 50 AS ord, count(*) AS len FROM lineitem GROUP BY 1, 2)"
OFFSETS = f"(SELECT *, coalesce(sum(len) OVER (PARTITION BY grp ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", (sum(len) OVER (PARTITION BY grp))::BIGINT AS total FROM {PARTS})"


def parts(t):  # noqa: ANN001, ANN201
    return t("lineitem").groupBy((F.col("l_suppkey") % 8).alias("grp"), (F.col("l_partkey") % 50).alias("ord")).agg(F.count("*").alias("len"))


@query("part_offsets", f"SELECT * FROM {OFFSETS}")
def part_offsets(t):  # noqa: ANN001, ANN201
    return series.part_offsets(parts(t), "grp", "ord", "len")


@query("locate_part", f"SELECT i.grp, i.idx, o.ord AS part, i.idx - o.\"offset\" AS local FROM (SELECT DISTINCT o_custkey % 8 AS grp, o_orderkey % 5000 AS idx FROM orders) i LEFT JOIN {OFFSETS} o ON i.grp = o.grp AND i.idx >= o.\"offset\" AND i.idx < o.\"offset\" + o.len")
def locate_part(t):  # noqa: ANN001, ANN201
    index = t("orders").select((F.col("o_custkey") % 8).alias("grp"), (F.col("o_orderkey") % 5000).alias("idx")).distinct()
    return series.locate_part(index, series.part_offsets(parts(t), "grp", "ord", "len"), "grp", "ord", "len")


BLOCK = "(SELECT floor(x / 1000)::BIGINT AS bx, floor(y / 1000)::BIGINT AS \"by\", {} AS value FROM <grid_values> GROUP BY 1, 2)"


@query("reconcile_blocks", f"SELECT bx, \"by\", p.value AS pooled, o.value AS official, abs(p.value - o.value) AS error FROM {BLOCK.format('sum(v)')} p JOIN {BLOCK.format('sum(v) + count(*) % 3')} o USING (bx, \"by\")")
def reconcile_blocks(t):  # noqa: ANN001, ANN201
    g = t("grid_values").groupBy(F.floor(F.col("x") / 1000).alias("bx"), F.floor(F.col("y") / 1000).alias("by")).agg(F.sum("v").alias("value"), F.count("*").alias("n"))
    return series.reconcile_blocks(g, g.withColumn("value", F.col("value") + F.col("n") % 3), ["bx", "by"])
