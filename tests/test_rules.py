"""Hand-checked numbers, semantic traps, invariants and plans of the spatial operators."""

import math

import pytest
from pyspark.sql import functions as F

from cellweave.functions import cells, classes, crs, pixels, scales, units, values
from cellweave.operators import align, catalog, pool, raster, series, stats
from cellweave.operators import spatial as sp
from cellweave.operators.pool import MetricSpec
from cellweave.sources import files
from cellweave.sources.shared import stored_in_ranges


def one(df):
    return df.first()[0]


def test_parse_value_markers(spark):
    texts = ["12,5", " 3 ", "–", "-", "—", ".", "…", "x", "k.A.", "", None, "-1", "1d", "nan", "1.5e2", "-4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", values.parse_value(F.col("t"), ("-1", "—")).alias("v")).orderBy("i").collect()]
    assert got == [12.5, 3.0, 0.0, 0.0, None, None, None, None, None, None, None, None, None, None, 150.0, -4.0]


def test_grid_ids(spark):
    df = spark.createDataFrame([("CRS3035RES100mN2689100E4337000",), ("N1E2",)], "t string")
    got = [r.g for r in df.select(values.parse_grid_id(F.col("t")).alias("g")).collect()]
    assert tuple(got[0]) == (100, 2689100, 4337000) and got[1] is None
    with pytest.raises(Exception, match="no grid id"):
        df.select(values.parse_grid_id(F.col("t"), strict=True)).collect()


def pooled(spark, spec, rows, names):
    df = spark.createDataFrame([("A", *r) for r in rows], f"cell string, {', '.join(f'{n} double' for n in names)}")
    got = pool.pool(df, spec, ["cell"]).select(pool.finish(spec)).collect()
    return got[0][0] if got else "absent"


def test_pooling_rules(spark):
    assert pooled(spark, MetricSpec("wmean", value="v", weight="w"), [(40.0, 1000.0), (60.0, 10.0), (None, 5.0), (9.0, 0.0), (9.0, None)], "vw") == pytest.approx(40600 / 1010)
    share = MetricSpec("share", numerator="n", denominator="d", min_denominator=25)
    assert pooled(spark, share, [(10.0, 10.0), (100.0, 1000.0), (None, 7.0)], "nd") == pytest.approx(110 / 1010)
    assert pooled(spark, share, [(2.0, 8.0)], "nd") is None
    assert pooled(spark, MetricSpec("hmean", value="v", weight="w"), [(1.0, 40.0), (4.0, 40.0), (0.0, 9.0)], "vw") == pytest.approx(1.6)
    assert pooled(spark, MetricSpec("sum", value="v"), [(3.0,), (None,)], "v") == 3.0
    assert pooled(spark, MetricSpec("sum", value="v"), [(None,)], "v") == "absent"


def test_dominant_ties_go_to_the_lowest_index(spark):
    df = spark.createDataFrame([("A", 70.0, 10.0, None), ("A", 10.0, 40.0, -5.0), ("B", 5.0, 5.0, 5.0), ("C", 0.0, None, 0.0)], "cell string, a double, b double, c double")
    got = {r.cell: (r.category, r.dominance) for r in pool.dominant(pool.pool_categories(df, ["a", "b", "c"], ["cell"]), ["cell"]).collect()}
    assert got == {"A": (0, 80 / 130), "B": (0, 1 / 3)}


def test_stats_take_the_element_at_the_floor(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(1, 1001)] + [("m", None), ("e", None)], "k string, v double")
    got = {r.k: r for r in stats.compute_stats(df, "v", ["k"], with_sum=True).collect()}
    assert (got["m"].min, got["m"].max, got["m"].p50, got["m"].p95, got["m"].p995, got["m"].sum, got["m"].n) == (1, 1000, 501, 951, 996, 500500, 1000)
    assert (got["e"].min, got["e"].max, got["e"].p50, got["e"].sum) == (0, 0, 0, 0)
    few = spark.createDataFrame([("m", 2.0)] * 7 + [("m", 5.0)] * 3, "k string, v double")
    r = stats.compute_stats(few, "v", ["k"]).first()
    assert (r.p50, r.p95) == (2, 5)


def lattice(spark, n=4000):
    return cells.with_cell(spark.range(n).select((F.col("id") * 7919 % 40000 + 4300000.0).alias("x"), (F.col("id") * 104729 % 40000 + 3000000.0).alias("y"), F.lit(1.0).alias("v")), "x", "y", 9)


def test_cells_hold_their_points_and_parents_compose(spark):
    rows = lattice(spark)
    x, y = cells.centre(F.col("cell"), 9)
    far = rows.select(F.max(F.sqrt(F.pow(x - F.col("x"), 2) + F.pow(y - F.col("y"), 2))))
    assert one(far) <= cells.EDGE_METRES[9] * 1.0000001
    at_once = cells.with_parent(rows, "cell", 9, 7, "a")
    by_step = cells.with_parent(cells.with_parent(at_once, "cell", 9, 8, "b"), "b", 8, 7, "c")
    assert by_step.filter("a <> c").count() == 0
    assert rows.select(cells.resolution(F.col("cell"))).distinct().collect()[0][0] == 9
    own = cells.with_cell(rows.select(x.alias("x"), y.alias("y"), F.col("cell").alias("was")), "x", "y", 9)
    assert own.filter("cell <> was").count() == 0


def test_rollup_keeps_sums_and_shuffles_once_after_the_base(spark):
    base = pool.pool(lattice(spark), MetricSpec("sum", value="v"), ["cell"])
    levels = pool.rollup(base, 9, [8, 7])
    r = stats.sum_invariant(levels.withColumn("m", F.lit(1)), "num", ["m"]).first()
    assert r.same and r.total == 4000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = levels._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 2


def test_projections_close(spark):
    df = spark.createDataFrame([(1, 6.1, 47.5), (2, 10.0, 52.0), (3, 14.9, 54.9)], "id int, lon double, lat double")
    laea = crs.to_laea(df)
    mid = laea.filter("id = 2").first()
    assert (round(mid.x, 3), round(mid.y, 3)) == (4321000, 3210000)
    back = crs.from_laea(laea.select("id", "x", "y", F.col("lon").alias("a"), F.col("lat").alias("b")))
    assert one(back.select(F.max(F.abs(F.col("lon") - F.col("a")) + F.abs(F.col("lat") - F.col("b"))))) < 1e-8
    for zone in (crs.UTM32, crs.GK3):
        there = crs.from_tm(crs.to_tm(df, zone, x="x", y="y"), zone, "x", "y", "a", "b")
        assert one(there.select(F.max(F.abs(F.col("lon") - F.col("a")) + F.abs(F.col("lat") - F.col("b"))))) < 1e-8
    utm = crs.to_tm(spark.createDataFrame([(9.0, 48.0)], "lon double, lat double"), crs.UTM32).first()
    assert utm.x == pytest.approx(500000) and utm.y == pytest.approx(5316300.22, abs=0.5)
    germany = crs.gk3_to_wgs84(spark.createDataFrame([(3500000.0, 5500000.0)], "x double, y double")).first()
    assert 8.9 < germany.lon < 9.1 and 49.5 < germany.lat < 49.8


def test_two_meanings_of_inside(spark):
    ring = lambda k, a, b: [("r", k, i, x, y) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    edges = sp.ring_edges(spark.createDataFrame(ring(0, 0.0, 10.0) + ring(1, 4.0, 6.0), "region string, ring int, pos int, x double, y double"))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 5.0)], "id int, lon double, lat double")
    assert sorted(r.id for r in sp.clip_to_rings(points, edges, "id").collect()) == [1, 2]
    assert sorted(r.id for r in sp.mask_region(points, edges, "id").filter("inside").collect()) == [2]


def test_units_over_the_years(spark):
    rows = [(1, 35, "2010-05-01", None), (2, 38, "2000-01-01", "2015-03-01"), (3, 38, "2000-01-01", None), (4, 31, "2000-01-01", None), (5, 37, "2012-12-31", None)]
    df = spark.createDataFrame(rows, "id int, status int, c string, d string").select("id", "status", F.to_date("c").alias("commissioned"), F.to_date("d").alias("decommissioned"))
    for year in (2009, 2010, 2014, 2015):
        want = {r.id for r in df.filter(units.installed_in_year(F.lit(year), F.col("status"), F.col("commissioned"), F.col("decommissioned"))).collect()}
        assert want == {r.id for r in units.expand_years(df, 2005, 2020).filter(F.col("year") == year).collect()}
    assert "Generate" in units.expand_years(df, 2005, 2020)._jdf.queryExecution().executedPlan().toString()


def test_forest_blocks(spark):
    mask = [[1, 1, 0, 0, 1], [1, 0, 0, 0, 1], [0, 0, 1, 1, 1], [0, 0, 1, 1, 1]]
    df = spark.createDataFrame([(r, c, v) for r, row in enumerate(mask) for c, v in enumerate(row)], "r int, c int, mask int")
    got = {(r.br, r.bc): r.forest for r in raster.block_reduce(df, 2, {"forest": F.col("mask") == 1}, "forest").collect()}
    assert got == {(0, 0): 3, (1, 1): 4}


def test_height_scale_midpoint(spark):
    df = spark.range(1).select(F.struct(F.lit(0.0).alias("min"), F.lit(10000.0).alias("max"), F.lit(1.0).alias("p50"), F.lit(10.0).alias("p95"), F.lit(100.0).alias("p995")).alias("s"))
    top = lambda p: one(df.select(scales.height_scale(F.col("s"), 100000.0, 0.995, p)))
    assert (top(0.0), top(1.0)) == (1000, 10) and top(0.5) == pytest.approx(100)
    assert one(df.select(scales.js_round(F.lit(-0.5)))) == 0 and one(df.select(scales.js_round(F.lit(2.5)))) == 3


def test_changes_and_baselines(spark):
    df = spark.createDataFrame([(100.0, 150.0), (10.0, 90.0), (None, 5.0), (50.0, None)], "b double, n double")
    assert [r[0] for r in df.select(series.change_pct(F.col("b"), F.col("n"))).collect()] == [0.5, None, None, None]


def test_alignment_and_fill(spark):
    u = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "res int, cell long")
    m = spark.createDataFrame([(9, 1, 5.0), (9, 7, 1.0)], "res int, cell long, value double")
    assert {r.cell: r.value for r in align.align(u, m).collect()} == {1: 5.0, 2: None, 3: None}
    assert {r.cell: r.value for r in align.align(u, m, "zero").collect()} == {1: 5.0, 2: 0.0, 3: 0.0}
    assert [r.cell for r in align.dropped_cells(m, u).collect()] == [7]
    assert [r.ord for r in align.universe_order(u).orderBy("cell").collect()] == [0, 1, 2]


def test_last_weight_wins_and_joins_never_multiply(spark):
    w = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, None)], "k string, seq int, w double")
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    got = align.join_weights(rows, align.last_weights(w, "k", "w", "seq"), "k").orderBy("k").collect()
    assert [(r.k, r.w) for r in got] == [("a", 3.0), ("b", None)]


def test_nearest_boxes_are_a_top_k(spark):
    b = spark.createDataFrame([("t", 1.0, 1.0, 2.0, 2.0)], "tile string, west double, south double, east double, north double")
    assert "TakeOrderedAndProject" in sp.nearest_boxes(b, 1.0, 1.0, 5)._jdf.queryExecution().executedPlan().toString()


def test_provenance_and_fingerprints(spark):
    import hashlib

    f = spark.createDataFrame([("one", "a", "11"), ("two", "b", "22"), ("two", "a", "33")], "k string, path string, digest string")
    got = {r.k: r.fingerprint for r in catalog.input_fingerprint(f, ["k"]).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = sorted(sha(v) for v in ("a\x0033", "b\x0022"))
    assert lines[0][:3] != lines[1][:3]  # each is alone in its buckets
    assert got == {"one": "11", "two": sha("\n".join(sorted(sha(sha(f"{h}:1")) for h in lines)))}
    repeated = catalog.rolled_digest(spark.createDataFrame([("k", "x")] * 3, "k string, line string"), ["k"]).first()
    assert (repeated.lines, repeated.digest) == (3, sha(sha(sha(f"{sha('x')}:3"))))


def test_ranges_follow_skewed_values(spark):
    tail = spark.range(4000).select(F.lit("m").alias("k"), F.exp(F.col("id") / 200.0).alias("v"))
    got = stats.compute_stats(tail, "v", ["k"], with_sum=True).first()
    want = [math.exp(i / 200.0) for i in range(4000)]
    assert math.isclose(got.p50, want[2000], abs_tol=1e-3) and math.isclose(got.p995, want[3980], abs_tol=1e-3) and got.n == 4000
    ranges = stored_in_ranges(tail.repartition(4), "k", "v").groupBy("_r").count().collect()
    assert max(r["count"] for r in ranges) <= 4000 * 1.5 / len(ranges)
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    assert {r.k: (r.min, r.max, r.p50) for r in stats.compute_stats(nulls, "v", ["k"]).collect()} == {None: (1, 3, 3), "a": (2, 2, 2)}
    empty = stats.compute_stats(spark.createDataFrame([], "k string, v double"), "v", ["k"])
    assert empty.count() == 0


def test_statistics_of_one_level_need_no_cartesian_product(spark):
    one = stats.compute_stats(spark.range(9).withColumn("res", F.lit(8)), "id", ["res"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_shade_equals_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.random() / 20, rng.random() / 20, float(rng.choice([0, 10, 10, 15, 20, 30, 500]))) for i in range(300)] + [(300, 9.0, 9.0, 1.0), (301, 0.01, 0.01, None), (302, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, height double")
    got = {r.id: r.shade for r in sp.neighbour_shade(df, "id", "height", 0.01, 20.0).collect()}
    placed = [r for r in rows if r[1] is not None]
    lon0, lat0 = min(r[1] for r in placed), min(r[2] for r in rows)  # the grid starts at the least of each coordinate
    at = {r[0]: (math.floor((r[1] - lon0) / 0.01), math.floor((r[2] - lat0) / 0.01)) for r in placed}
    for i, _, _, h in rows:
        near = [r for r in placed if i in at and h is not None and r[0] != i and max(abs(at[r[0]][0] - at[i][0]), abs(at[r[0]][1] - at[i][1])) <= 1]
        rise = [min(1.0, max(0.0, (r[3] - h) / 20.0)) if r[3] is not None else 0.0 for r in near]
        assert math.isclose(got[i], sum(rise) / len(rise) if rise else 0.0, abs_tol=1e-9)


def test_many_places_meet_points_by_shuffle(spark, tiny):
    from cellweave.sources.views import view

    points, places = view(spark, tiny, "points"), view(spark, tiny, "places")
    sent, met = (sorted(tuple(r) for r in sp.nearest_place(points, places, "id", max_broadcast=m).collect()) for m in (50_000, 3))
    assert sent == met and sent


def test_tiles_and_pixels(spark):
    box = spark.createDataFrame([(5.0, 47.0, 15.0, 55.0)], "west double, south double, east double, north double")
    assert sorted(r.tile for r in pixels.tiles_for_bbox(box).collect()) == ["h18v03", "h18v04", "h19v03", "h19v04"]
    w, n = spark.range(1).select(*pixels.tile_origin(F.lit("h18v03"))).first()
    assert (w, n) == (0, 60)
    assert classes.artificial_groups(spark) == [0, 1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("GITTER_ID_100m;x_mp_100m;y_mp_100m;Öl\nCRS3035RES100mN1E2;4300050;3000050;–\nCRS3035RES100mN1E3;4300150;3000050;2,5\n".encode("cp1252"))
    got = files.scan_grid_csv(spark, str(tmp_path / "g.csv"), ["Öl"], encoding="cp1252").orderBy("x").collect()
    assert [(r.x, r["Öl"]) for r in got] == [(4300050.0, 0.0), (4300150.0, 2.5)]
    with pytest.raises(ValueError, match="lacks Gas"):
        files.scan_grid_csv(spark, str(tmp_path / "g.csv"), ["Gas"], encoding="cp1252")
    head = "NCOLS 3\nNROWS 2\nXLLCORNER 10\nYLLCORNER 20\nCELLSIZE 2\nNODATA_VALUE -999\n"
    (tmp_path / "r.asc").write_text(head + "1 2 -999\n4 -999 6\n")
    got = {(r.x, r.y): r.value for r in files.scan_ascii_grid(spark, str(tmp_path / "r.asc"), 10).collect()}
    assert got == {(11.0, 23.0): 10.0, (13.0, 23.0): 20.0, (11.0, 21.0): 40.0, (15.0, 21.0): 60.0}
    (tmp_path / "bad.asc").write_text(head + "1 2\n4 5 6\n")
    with pytest.raises(Exception, match="wrong width"):
        files.scan_ascii_grid(spark, str(tmp_path / "bad.asc")).collect()
    unit = "<EinheitWind><EinheitMastrNummer>{}</EinheitMastrNummer><Laengengrad>{}</Laengengrad><Breitengrad>52,1</Breitengrad><Bruttoleistung>3000</Bruttoleistung><Inbetriebnahmedatum>2010-05-01T00:00</Inbetriebnahmedatum><EinheitBetriebsstatus>35</EinheitBetriebsstatus><Lage>888</Lage></EinheitWind>"
    (tmp_path / "u.xml").write_bytes(('<?xml version="1.0" encoding="UTF-16"?><EinheitenWind>' + unit.format("SEE1", "9,5") + unit.format("SEE2", "") + "</EinheitenWind>").encode("utf-16"))
    got = files.scan_unit_xml(spark, str(tmp_path / "u.xml")).collect()
    assert [(r.id, r.lon, r.lat, r.kw, str(r.commissioned), r.status) for r in got] == [("SEE1", 9.5, 52.1, 3000.0, "2010-05-01", 35)]
    for name, lines in (("w1.csv", "a;1\na;–\nb;2\nc;.\n"), ("w2.csv", "b;5\na;.\n")):
        (tmp_path / "w").mkdir(exist_ok=True)
        (tmp_path / "w" / name).write_text("GITTER_ID_100m;Einwohner\n" + lines)
    got = files.scan_weights(spark, str(tmp_path / "w"), "Einwohner")
    assert {r.grid_id: r.weight for r in got.collect()} == {"a": 0.0, "b": 5.0}
    areas = spark.createDataFrame([("x", 9, [[(1.0, 2.0), (3.0, 4.0)]])], "name string, gf int, rings array<array<struct<x:double,y:double>>>")
    with pytest.raises(ValueError, match="1 areas instead of 16"):
        files.scan_admin_areas(areas, expected=16)
    with pytest.raises(ValueError, match="fields differ"):
        files.union_same_schema([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])


def test_stream_of_rows_pools_like_a_batch(spark, tmp_path):
    from cellweave.streaming import increments

    rows = spark.range(200).select((F.col("id") % 3).alias("cell"), F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = increments.pooled_stream(stream, MetricSpec("sum", value="v"), ["cell"], "at", late="0 seconds")
    increments.to_table(out, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = {(r.window.start, r.cell): r.num for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window.start, r.cell): r.num for r in rows.groupBy(F.window("at", "1 day"), "cell").agg(F.sum("v").alias("num")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 3


def test_bells_reach_as_far_as_they_matter():
    assert math.exp(-((260 / 26) ** 2) / 2) < 1e-21


def star(rng, n, cx=0.0, cy=0.0):
    """A closed ring of n corners that turns around a centre."""
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    ring = [(cx + (0.3 + rng.random()) * math.cos(t), cy + (0.3 + rng.random()) * math.sin(t)) for t in turns]
    return [*ring, ring[0]]


def odd(ring, x, y):
    """Edges to the right of a point, by hand."""
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


def test_masks_equal_even_odd_by_hand(spark):
    import random

    rng = random.Random(11)
    rings = [star(rng, n) for n in (4, 9, 60)] + [[(-1.0, -0.5), (1.0, -0.5), (1.0, 0.5), (-1.0, 0.5), (-1.0, -0.5)]]  # the last lies on the grid
    corners = [("r", k, i, x, y) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring[:-1])]
    edges = sp.ring_edges(spark.createDataFrame(corners, "region string, ring int, pos int, x double, y double"))
    places = [(rng.uniform(-1.6, 1.6), rng.uniform(-1.6, 1.6)) for _ in range(1500)] + [(x / 4, y / 4) for x in range(-6, 7) for y in range(-6, 7)] + [c for ring in rings for c in ring]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)] + [(-1, None, 0.0)], "id long, lon double, lat double")
    for side in (0.25, 0.07):
        inside = {r.id for r in sp.mask_region(points, edges, "id", side=side).filter("inside").collect()}
        any_ = {r.id for r in sp.clip_to_rings(points, edges, "id", side=side).collect()}
        want = [[odd(ring, x, y) for ring in rings] for x, y in places[: 1500 + 169]]
        assert {i for i in inside if i < len(want)} == {i for i, w in enumerate(want) if sum(w) % 2}
        assert {i for i in any_ if i < len(want)} == {i for i, w in enumerate(want) if any(w)}


def test_masks_join_on_squares_alone(spark):
    edges = spark.createDataFrame([("r", 0, 0.0, 0.0, 1.0, 1.0)], "region string, ring int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, lon double, lat double")
    plan = sp.mask_region(points, edges, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "_bx" in plan and "_by" in plan and "band" not in plan
    wide = spark.createDataFrame([("r", 0, 0.0, 0.01, 40.0, 0.05), ("r", 0, 40.0, 0.05, 0.0, 0.09), ("r", 0, 0.0, 0.09, 0.0, 0.01)], edges.schema)
    assert sp.cover_index(wide, [], 0.1).groupBy("_bx", "_by").count().agg(F.max("count")).first()[0] <= 4


def test_cover_of_a_ring_of_many_corners(spark):
    """100,000 corners around 3,000 cells: as many cells as the area says, and the cells of the polygon without its tremor."""
    n, r, a = 100_000, 4000.0, cells.EDGE_METRES[10]
    ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((F.cos(i % n * (2 * math.pi / n)) * (r + (i % 2) * 0.001) + 4.3e6).alias("x"), (F.sin(i % n * (2 * math.pi / n)) * (r + (i % 2) * 0.001) + 3.0e6).alias("y")))
    got = sp.polygon_cover(spark.range(1).select("id", F.array(ring).alias("rings")), 10)
    x, y = cells.centre(F.col("cell"), 10)
    far = F.sqrt(F.pow(x - 4.3e6, 2) + F.pow(y - 3.0e6, 2))
    rows = got.agg(F.count("*").alias("n"), F.countDistinct("cell").alias("cells"), F.max(far).alias("far"), F.count_if(far < r - 0.01).alias("sure")).first()
    near = spark.range(-70, 71).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-90), F.lit(90))).alias("j"))
    row = F.floor(F.lit(3.0e6 / (a * 1.5))) + F.col("i")
    column = F.floor(F.lit(4.3e6 / (a * cells.ROOT3)) - row / 2) + F.col("j")
    there = near.select((F.sqrt(F.pow((column + row / 2) * (a * cells.ROOT3) - 4.3e6, 2) + F.pow(row * (a * 1.5) - 3.0e6, 2)) < r - 0.01).alias("in")).filter("in").count()
    assert rows.n == rows.cells and rows.far <= r + 0.01 and rows.sure == there > 3000


def test_cover_of_repeated_parts_and_parts_of_one_name(spark):
    square = lambda x, s: [[(x, 0.0), (x + s, 0.0), (x + s, s), (x, s), (x, 0.0)]]
    df = spark.createDataFrame([(1, square(0.0, 900.0)), (1, square(0.0, 900.0)), (1, square(300.0, 900.0)), (2, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), (3, None)], "id int, rings array<array<struct<x:double,y:double>>>")
    one = sp.polygon_cover(df.limit(1), 10).count()
    got = sp.polygon_cover(df, 10).groupBy("id").count().collect()
    assert [r.id for r in got] == [1] and got[0]["count"] == 2 * one + sp.polygon_cover(spark.createDataFrame([(1, square(300.0, 900.0))], df.schema), 10).count()


def test_a_dense_bin_is_many_tasks_work(spark):
    """All points in one bin, half of them at one height: the ranges deal them out, and equal heights are asked about once."""
    df = spark.range(4000).select("id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id") % 997).cast("double").alias("height"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        got = {r.id: r.shade for r in sp.neighbour_shade(df, "id", "height", 0.01, 20.0).collect()}
        asked = spark.range(1000).select(F.lit(0).alias("c"), F.col("id").cast("double").alias("at"))
        assert stored_in_ranges(asked.repartition(4), "c", "at").select("_r").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    heights = [7.0 if i % 2 == 0 else float(i % 997) for i in range(4000)]
    for i in (0, 1, 77, 996, 1993, 3999):
        assert math.isclose(got[i], sum(min(1.0, max(0.0, (h - heights[i]) / 20)) for h in heights) / 3999, abs_tol=1e-9)


def test_reading_at_the_step_shown(spark):
    fine = spark.createDataFrame([(1, 10, 2000, 5.0), (1, 10, 2002, None), (1, 10, 2004, 9.0), (1, 11, 2003, 4.0), (2, 20, 2000, None)], "under long, cell long, step int, value double")
    coarse = spark.createDataFrame([(1, 1999, 50.0), (1, 2001, 60.0), (1, 2005, 70.0), (3, 2000, 1.0)], "cell long, step int, value double")
    read = lambda shown: {r.cell: r.value for r in series.fine_or_coarse(fine, coarse, shown).collect()}
    assert read(2002) == {10: 5.0, 11: 60.0, 20: None} and read(2004) == {10: 9.0, 11: 4.0, 20: None} and read(1998) == {10: None, 11: None, 20: None}
    once = series.fine_or_coarse(fine.filter("step in (2002, 2003)").drop("step"), coarse.filter("step = 2001").drop("step"))
    assert {r.cell: r.value for r in once.collect()} == {10: 60.0, 11: 4.0}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = series.fine_or_coarse(fine, coarse, 2002)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange") == 1


def test_one_changed_byte_changes_the_fingerprint(spark, tmp_path):
    import hashlib

    for name, text in (("a.bin", "one"), ("b.bin", "two")):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    listed = files.listing(spark, str(tmp_path / "in"))
    assert {(r.name, r["size"]) for r in listed.collect()} == {("a.bin", 3), ("b.bin", 3)}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    printed = lambda: catalog.input_fingerprint(files.digests(spark, str(tmp_path / "in")).withColumn("k", F.lit(1)), ["k"]).first().fingerprint
    stamped = lambda: catalog.level_stamp(files.listing(spark, str(tmp_path / "in")).withColumn("k", F.lit(1)), ["k"]).first().stamp
    print_, stamp = printed(), stamped()
    assert (printed(), stamped()) == (print_, stamp)
    (tmp_path / "in" / "b.bin").write_text("twO")
    assert printed() != print_ and stamped() != stamp
    (tmp_path / "in" / "a.bin").unlink()
    assert printed() == hashlib.sha256(b"twO").hexdigest()


def test_a_raster_is_read_in_byte_ranges(spark, tmp_path):
    import gzip

    text = "NCOLS 30\nNROWS 400\nXLLCORNER 0\nYLLCORNER 0\nCELLSIZE 1\nNODATA_VALUE -9\n" + "".join(" ".join(str(r * 30 + c if c else -9) for c in range(30)) + ("\n\n" if r % 50 == 0 else "\n") for r in range(400))
    (tmp_path / "plain").mkdir()
    (tmp_path / "zip").mkdir()
    (tmp_path / "plain" / "r.asc").write_text(text)
    (tmp_path / "zip" / "r.asc.gz").write_bytes(gzip.compress(text.encode()))
    want = {(c + 0.5, 399.5 - r): float(r * 30 + c) for r in range(400) for c in range(1, 30)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for kind, least in (("plain", 5), ("zip", 1)):
            at = str(tmp_path / kind)
            parts = spark.read.text(at).rdd.getNumPartitions()
            assert parts >= least and (kind == "plain" or parts == 1)
            assert {(r.x, r.y): r.value for r in files.scan_ascii_grid(spark, at).collect()} == want
            assert {r.y for r in files.scan_ascii_grid(spark, at, rows=(10, 12)).collect()} == {389.5, 388.5}
        (tmp_path / "plain" / "r.asc").write_text(text.rsplit("\n", 2)[0] + "\n")
        with pytest.raises(Exception, match="another number of rows"):
            files.scan_ascii_grid(spark, str(tmp_path / "plain")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
