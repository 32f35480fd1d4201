"""Readers over files that Spark derives from the tables, and the jobs from source to aligned metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import cells, classes, crs, pixels, scales, units
from cellweave.operators import align, pool, raster, series, stats
from cellweave.operators import spatial as sp
from cellweave.plans import atlas as at
from cellweave.plans import pooling as po
from cellweave.plans import spatial as ps
from cellweave.plans.registry import cell_sql, parent_sql, query
from cellweave.sources import files

# --- readers


@query("scan_grid_csv", "SELECT grid_id, (east + 50)::DOUBLE AS x, (north + 50)::DOUBLE AS y, count(*) AS rows, sum(v) AS total FROM (SELECT *, CASE WHEN l_orderkey % 10 = 0 THEN 0.0 WHEN l_orderkey % 10 IN (1, 2) THEN NULL ELSE l_quantity END AS v FROM (SELECT g.*, l_quantity FROM <grid_rows> JOIN (SELECT NULL AS l_quantity) AS z ON FALSE) AS g) GROUP BY ALL".replace("(SELECT g.*, l_quantity FROM <grid_rows> JOIN (SELECT NULL AS l_quantity) AS z ON FALSE) AS g", "(SELECT *, 4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200) AS east, 3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200) AS north, 'CRS3035RES100mN' || (3000000 + 100 * ((l_suppkey * 104729 + l_orderkey * 17) % 200)) || 'E' || (4300000 + 100 * ((l_partkey * 7919 + l_orderkey * 31) % 200)) AS grid_id FROM lineitem) AS g"))
def scan_grid_csv(t):  # noqa: ANN001, ANN201
    path, g = at.folder(t, "csv"), t("grid_rows")
    g.select(F.col("grid_id").alias("GITTER_ID_100m"), F.col("value_text").alias("Einwohner")).write.option("sep", ";").option("header", True).csv(path)
    rows = files.scan_grid_csv(g.sparkSession, path, ["Einwohner"], missing=("-1",))
    return rows.groupBy("grid_id", "x", "y").agg(F.count("*").alias("rows"), F.sum("Einwohner").alias("total"))


GRID = "(SELECT r % 200 AS r, c % 250 AS c, min(CASE WHEN raw < 5000 THEN -1 ELSE raw END) AS raw FROM <pixels> GROUP BY 1, 2)"


@query("scan_ascii_grid", f"SELECT 1000.0::DOUBLE + (c + 0.5) * 100 AS x, 2000.0::DOUBLE + (200 - r - 0.5) * 100 AS y, raw * 0.1::DOUBLE AS value FROM {GRID} WHERE raw <> -1")
def scan_ascii_grid(t):  # noqa: ANN001, ANN201
    """The pixels written as one uncompressed raster and read in byte ranges."""
    path, p = at.folder(t, "asc"), t("pixels")
    grid = p.groupBy((F.col("r") % 200).alias("r"), (F.col("c") % 250).alias("c")).agg(F.min(F.when(F.col("raw") < 5000, -1).otherwise(F.col("raw"))).alias("raw"))
    every = p.sparkSession.range(200).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(249).cast("long"))).alias("c")).join(grid, ["r", "c"], "left")
    lines = every.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("raw", F.lit(-1)).alias("raw")))), lambda v: v["raw"].cast("string")), " ").alias("value"))
    head = ["NCOLS 250", "NROWS 200", "XLLCORNER 1000", "YLLCORNER 2000", "CELLSIZE 100", "NODATA_VALUE -1"]
    head = p.sparkSession.range(1).select(F.posexplode(F.lit(head)).alias("i", "value")).select((F.col("i") - len(head)).cast("long").alias("r"), "value")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("r").select("value").write.text(path)
    return files.scan_ascii_grid(p.sparkSession, path, 0.1).select("x", "y", "value")


@query("scan_polygons", "SELECT trim(code) AS code, count(*) AS parts, sum(CASE WHEN hole THEN 2 ELSE 1 END)::BIGINT AS rings FROM <squares> WHERE id % 7 <> 0 GROUP BY 1")
def scan_polygons(t):  # noqa: ANN001, ANN201
    path, p = at.folder(t, "polygons"), ps.square_polygons(t)
    p.select(F.col("code").alias("CLC"), F.when(F.col("id") % 7 != 0, F.array("rings")).alias("polygons")).write.json(path)
    rows = files.scan_polygons(p.sparkSession, path, "CLC")
    return rows.groupBy(F.trim("code").alias("code")).agg(F.count("*").alias("parts"), F.sum(F.size("rings")).alias("rings"))


@query("scan_rings", "SELECT ring, pos, x, y FROM (SELECT n_regionkey::INT AS ring, (row_number() OVER (PARTITION BY n_regionkey ORDER BY ord) - 1)::INT AS pos, lon AS x, lat AS y FROM <places> JOIN nation ON ord = n_nationkey)")
def scan_rings(t):  # noqa: ANN001, ANN201
    path, p = at.folder(t, "rings"), t("places").join(t("nation"), F.col("ord") == F.col("n_nationkey"))
    ring = p.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"])).alias("p"))
    ring.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "p"))), lambda v: v["p"]).alias("rings")).write.json(path)
    return files.scan_rings(p.sparkSession, path).select("ring", "pos", "x", "y")


@query("union_same_schema", "SELECT status, count(*) AS units FROM <units> GROUP BY status")
def union_same_schema(t):  # noqa: ANN001, ANN201
    u = t("units")
    parts = [u.filter(F.col("id") % 3 == 0), u.filter(F.col("id") % 3 == 1).select(*reversed(u.columns)), u.filter(F.col("id") % 3 == 2)]
    return files.union_same_schema(parts).groupBy("status").agg(F.count("*").alias("units"))


@query("flatten_catalogue", "SELECT id, name, 'https://example.org/' || folder || '/' || name AS url FROM <files> WHERE name LIKE '%.h5' AND id % 3 <> 0")
def flatten_catalogue(t):  # noqa: ANN001, ANN201
    link = lambda kind, start: F.struct(F.lit(kind).alias("Type"), F.concat(F.lit(start), "folder", F.lit("/"), "name").alias("URL"))
    urls = F.array(F.when(F.col("id") % 3 != 0, link("GET DATA", "https://example.org/")).otherwise(link("VIEW", "https://example.org/")), link("GET DATA", "s3://bucket/"))
    text = F.to_json(F.struct(F.array(F.struct(F.struct(urls.alias("RelatedUrls")).alias("umm"))).alias("items")))
    return files.flatten_catalogue(t("files").select("id", text.alias("j")), "j", ["id"])


@query("scan_admin_areas", "SELECT id AS name, CASE WHEN hole THEN 10 ELSE 5 END::BIGINT AS n_points, x0 AS west, y0 AS south, x0 + side AS east, y0 + side AS north FROM <squares> WHERE id % 3 = 0")
def scan_admin_areas(t):  # noqa: ANN001, ANN201
    path, p = at.folder(t, "areas"), ps.square_polygons(t).select(F.col("id").alias("name"), (F.col("id") % 3 + 9).alias("gf"), "rings")
    p.write.json(path)
    return files.scan_admin_areas(p.sparkSession.read.schema(p.schema).json(path), expected=t("squares").filter("id % 3 = 0").count())


@query("scan_weights", f"SELECT grid_id, weight FROM {po.WEIGHTS}")
def scan_weights(t):  # noqa: ANN001, ANN201
    path, w = at.folder(t, "weights"), t("weight_rows")
    text = F.coalesce(F.col("weight").cast("string"), F.lit("."))
    w.orderBy("seq").select(F.col("grid_id").alias("GITTER_ID_100m"), text.alias("Einwohner")).write.option("sep", ";").option("header", True).csv(path)
    return files.scan_weights(w.sparkSession, path, "Einwohner")


@query("scan_unit_xml", f"SELECT status, count(*) AS units, sum(kw) AS kw FROM {ps.USABLE} GROUP BY status")
def scan_unit_xml(t):  # noqa: ANN001, ANN201
    path, u = at.folder(t, "xml"), t("units")
    fields = {"EinheitMastrNummer": "id", "Laengengrad": "lon", "Breitengrad": "lat", "Bruttoleistung": "kw", "Inbetriebnahmedatum": "commissioned", "DatumEndgueltigeStilllegung": "decommissioned", "EinheitBetriebsstatus": "status", "Lage": "lage"}
    tagged = u.select(*[F.col(c).cast("string").alias(tag) for tag, c in fields.items()])
    tagged.write.format("xml").option("rowTag", "EinheitWind").option("rootTag", "EinheitenWind").option("charset", "UTF-16").option("declaration", 'version="1.0" encoding="UTF-16"').save(path)
    return files.scan_unit_xml(u.sparkSession, path).groupBy("status").agg(F.count("*").alias("units"), F.sum("kw").alias("kw"))


# --- jobs

RAIN = cell_sql("(SELECT step, raw * 0.1::DOUBLE AS v, 4300000.0::DOUBLE + (c + 0.5) * 100 AS x, 3000000.0::DOUBLE + (2400 - r - 0.5) * 100 AS y FROM <pixels> WHERE raw <> -999)", 8)
UP1 = "SELECT step, {r} AS res, {c} AS cell, sum(num) AS num, sum(den) AS den FROM {src} GROUP BY ALL"


def yearly(base: str, res: int) -> str:
    """Two levels of (step, cell, num, den), each pooled from the base."""
    return f"({UP1.format(r=res, c='cell', src=base)} UNION ALL {UP1.format(r=res - 1, c='up', src=parent_sql(base, res, res - 1))})"


RAIN_LEVELS = yearly(f"(SELECT step, cell, sum(v) AS num, count(v)::DOUBLE AS den FROM {RAIN} GROUP BY step, cell)", 8)


def aligned_steps(levels, fill: str = "null"):  # noqa: ANN001, ANN201
    """Each cell of any step at every step."""
    steps = levels.select("step").distinct().agg(F.collect_set("step").alias("s"))
    universe = align.universe_union([levels]).join(F.broadcast(steps)).select("res", "cell", F.explode("s").alias("step"))
    out = universe.join(levels, ["res", "cell", "step"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if fill == "zero" else out


def aligned_sql(levels: str, value: str, absent: str = "NULL") -> str:
    return f"SELECT u.res, u.cell, s.step, coalesce(round({value}, 4), {absent}) AS value FROM (SELECT DISTINCT res, cell FROM {levels}) u CROSS JOIN (SELECT DISTINCT step FROM {levels}) s LEFT JOIN {levels} v ON v.res = u.res AND v.cell = u.cell AND v.step = s.step"


@query("job_rain", aligned_sql(RAIN_LEVELS, "num / den"))
def job_rain(t):  # noqa: ANN001, ANN201
    x, y = pixels.ascii_cell_centre(F.col("r"), F.col("c"), F.lit(4300000.0), F.lit(3000000.0), F.lit(2400), F.lit(100))
    rows = t("pixels").withColumns({"v": pixels.pixel_value(F.col("raw"), -999, 0.1), "x": x.cast("double"), "y": y.cast("double")}).select("step", "v", "x", "y")
    base = pool.pool(cells.with_cell(rows, "x", "y", 8), po.MEAN, ["step", "cell"])
    levels = pool.rollup(base, 8, [7], ("step",))
    return aligned_steps(levels.select("res", "cell", "step", F.round(pool.finish(po.MEAN), 4).alias("value")))


NIGHT = cell_sql(ps.laea_sql("(SELECT step, CASE WHEN raw > 30000 THEN raw ELSE 0 END::DOUBLE AS v, (c + 0.5) * (10.0::DOUBLE / 2400) AS lon, CASE tile WHEN 'h18v03' THEN 60 ELSE 50 END - (r + 0.5) * (10.0::DOUBLE / 2400) AS lat FROM <pixels> WHERE raw <> -999 AND quality IN (0, 2))"), 7)
NIGHT_LEVELS = yearly(f"(SELECT step, cell, sum(v) AS num, count(v)::DOUBLE AS den FROM {NIGHT} GROUP BY step, cell)", 7)


@query("job_nightlight", aligned_sql(NIGHT_LEVELS, "num / den"))
def job_nightlight(t):  # noqa: ANN001, ANN201
    v = pixels.pixel_value(F.col("raw"), -999)
    lon, lat = pixels.pixel_centre(F.col("tile"), F.col("r"), F.col("c"))
    rows = t("pixels").filter(pixels.quality_mask(v, F.col("quality"))).select("step", pixels.floor_clamp(v, 30000).alias("v"), lon.alias("lon"), lat.alias("lat"))
    base = pool.pool(cells.with_cell(crs.to_laea(rows), "x", "y", 7), po.MEAN, ["step", "cell"])
    levels = pool.rollup(base, 7, [6], ("step",))
    return aligned_steps(levels.select("res", "cell", "step", F.round(pool.finish(po.MEAN), 4).alias("value")))


WIND = cell_sql(ps.laea_sql(f"(SELECT year AS step, lon, lat, kw / 1000 AS v FROM {ps.YEARS} WHERE lon BETWEEN 6 AND 13 AND lat BETWEEN 48 AND 54)"), 7)
WIND_LEVELS = yearly(f"(SELECT step::INT AS step, cell, sum(v) AS num, count(v) AS den FROM {WIND} GROUP BY 1, 2)", 7)


@query("job_wind", aligned_sql(WIND_LEVELS, "num", "0.0"))
def job_wind(t):  # noqa: ANN001, ANN201
    u = units.usable_units(t("units")).filter(pixels.in_box(F.col("lon"), F.col("lat"), 6, 48, 13, 54))
    u = units.expand_years(u, 1995, 2001).select(F.col("year").alias("step"), "lon", "lat", (F.col("kw") / 1000).alias("v"))
    levels = pool.rollup(pool.pool(cells.with_cell(crs.to_laea(u), "x", "y", 7), po.SUM, ["step", "cell"]), 7, [6], ("step",))
    return aligned_steps(levels.select("res", "cell", "step", F.round("num", 4).alias("value")), "zero")


LAND = f"(SELECT up AS cell, grp AS category, count(*) AS n FROM {parent_sql(f'(SELECT cell, grp FROM {ps.COVER} JOIN {at.CODES} ON c = trim(code))', 10, 9)} GROUP BY 1, 2)"


@query("pool_class_area", f"SELECT cell, category, n FROM {LAND}")
def pool_class_area(t):  # noqa: ANN001, ANN201
    return land_counts(t)


def land_counts(t):  # noqa: ANN001, ANN201
    cover = sp.polygon_cover(classes.with_group(ps.square_polygons(t), "code"), 10)
    return cells.with_parent(cover, "cell", 10, 9, "up").groupBy(F.col("up").alias("cell"), F.col("grp").alias("category")).agg(F.count("*").alias("n"))


LAND_UP = f"(SELECT 9 AS res, * FROM {LAND} UNION ALL SELECT 8 AS res, up AS cell, category, sum(n)::BIGINT AS n FROM {parent_sql(LAND, 9, 8)} GROUP BY up, category)"


@query("job_land", f"SELECT res, cell, round(coalesce(sum(n) FILTER (category IN (0, 1, 2)), 0) / sum(n), 6) AS artificial_share, arg_max(category, n * 100 - category) AS dominant, round(max(n) / sum(n), 6) AS dominance FROM {LAND_UP} GROUP BY res, cell")
def job_land(t):  # noqa: ANN001, ANN201
    counts = pool.levels(land_counts(t), 9, [8]).groupBy("res", "cell", "category").agg(F.sum("n").alias("n"))
    out = pool.class_shares(counts, classes.artificial_groups(counts.sparkSession), ["res", "cell"])
    return out.select("res", "cell", F.round("artificial_share", 6).alias("artificial_share"), "dominant", F.round("dominance", 6).alias("dominance"))


WOOD = cell_sql(f"(SELECT *, 4300000.0::DOUBLE + (bc * 2 + 1) * 30 AS x, 3000000.0::DOUBLE + (br * 2 + 1) * 30 AS y FROM {ps.BLOCKS})", 10)
WOODS = f"(SELECT 10 AS res, cell, sum(forest)::BIGINT AS forest, sum(disturbed)::BIGINT AS disturbed FROM {WOOD} GROUP BY cell)"


@query("job_forest", f"SELECT res, cell, forest, disturbed, round(least(1.0, forest * 0.0009::DOUBLE / CASE res WHEN 10 THEN {cells.area_km2(10)!r} ELSE {cells.area_km2(9)!r} END::DOUBLE), 6) AS forest_share, round(least(1.0, disturbed::DOUBLE / forest), 6) AS disturbed_share FROM (SELECT * FROM {WOODS} UNION ALL SELECT 9, up, sum(forest)::BIGINT, sum(disturbed)::BIGINT FROM {parent_sql(WOODS, 10, 9)} GROUP BY up)")
def job_forest(t):  # noqa: ANN001, ANN201
    blocks = raster.block_reduce(t("forest_pixels"), 2, ps.flags(), "forest")
    placed = blocks.withColumns({"x": F.col("c_centre") * 30 + 4300000.0, "y": F.col("r_centre") * 30 + 3000000.0})
    columns = ["forest", "disturbed", *ps.AGENTS]
    base = pool.pool_counts(cells.with_cell(placed, "x", "y", 10), columns, ["cell"])
    levels = pool.pool_counts(pool.levels(base, 10, [9]), columns, ["res", "cell"])
    parts = [raster.forest_metrics(levels.filter(F.col("res") == r), ps.AGENTS, cells.area_km2(r)) for r in (10, 9)]
    out = parts[0].unionByName(parts[1])
    return out.select("res", "cell", "forest", "disturbed", F.round("forest_share", 6).alias("forest_share"), F.round("disturbed_share", 6).alias("disturbed_share"))


SCENE = f"(SELECT *, ((((cell >> 26) & 67108863) - 33554432) + ((cell & 67108863) - 33554432) / 2.0::DOUBLE) * {cells.EDGE_METRES[8] * cells.ROOT3!r}::DOUBLE AS x, ((cell & 67108863) - 33554432) * {cells.EDGE_METRES[8] * 1.5!r}::DOUBLE AS y FROM {at.VALUES} WHERE res = 8)"
FOCUS = "x >= 4304000 AND x < 4311000 AND y >= 3003000 AND y < 3012000"


COLOURED = at.stops_sql("CASE WHEN min >= 0 THEN v / p995 ELSE (v - min) / (p995 - min) END", SCENE, "cell, v, x, y, min, max, p50, p95, p995")
DIMMED = ", ".join(f"CASE WHEN {FOCUS} THEN {c} ELSE floor({c} + ({scales.PAPER[k]} - {c}) * 0.72::DOUBLE)::INT END AS {c}" for k, c in enumerate("rgb"))


@query("job_view", f"SELECT cell, round(greatest(0, v * {at.SCALE}) * CASE WHEN {FOCUS} THEN 1 ELSE 0.28 END, 5) AS height, {FOCUS} AS inside, {DIMMED} FROM ({COLOURED})")
def job_view(t):  # noqa: ANN001, ANN201
    """Heights and colours of one level, the region in focus."""
    scene = at.with_stats(t).filter("res = 8")
    x, y = cells.centre(F.col("cell"), 8)
    scene = scene.withColumns({"x": x, "y": y, "h": scales.elevation(F.col("v"), scales.height_scale(F.col("stats")))})
    low, high = scales.sequential_domain(F.col("stats"), 0.995)
    scene = scene.withColumn("color", scales.color_sequential(F.col("v"), low, high, at.STOPS))
    corners = at.inline(t, "('f', 0, 0, 4304000D, 3003000D), ('f', 0, 1, 4311000D, 3003000D), ('f', 0, 2, 4311000D, 3012000D), ('f', 0, 3, 4304000D, 3012000D)", "region, ring, pos, x, y")
    scene = sp.mask_region(scene, sp.ring_edges(corners), "cell", "x", "y", 1000.0)
    height, color = scales.region_dim(F.col("h"), F.col("color"), F.col("inside"))
    return at.channels(scene.withColumn("height", F.round(height, 5)), color, "cell", "height", "inside")


CHANGES = f"(SELECT a.cell, CASE WHEN a.value >= 100000 THEN (b.value - a.value) / a.value END AS v FROM (SELECT * FROM {ps.STEPS} WHERE step = 1998) a JOIN (SELECT * FROM {ps.STEPS} WHERE step = 2000) b USING (cell))"


@query("job_change_map", at.stops_sql("0.5 + v / (2 * greatest(abs(lo), abs(hi)))", f"(SELECT *, round_even(min(v) OVER (), 4) AS lo, round_even(max(v) OVER (), 4) AS hi FROM {CHANGES})", "cell"))
def job_change_map(t):  # noqa: ANN001, ANN201
    both = series.join_two_steps(*ps.two_steps(t))
    both = both.withColumn("v", series.change_pct(F.col("before"), F.col("now"), 100000))
    s = stats.compute_stats(both, "v", ["res"]).select("res", F.struct("min", "max", "p50", "p95", "p995").alias("stats"))
    return at.channels(both.join(F.broadcast(s), "res"), scales.color_diverging(F.col("v"), F.col("stats"), at.STOPS), "cell")
