"""Queries of values, cells, pooling, statistics and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import cells, values
from cellweave.operators import align, pool, stats
from cellweave.operators.pool import MetricSpec
from cellweave.plans.registry import cell_sql, parent_sql, query

RES, UP = 9, [8, 7]
SUM, MEAN = MetricSpec("sum", value="v"), MetricSpec("mean", value="v")
WMEAN, HMEAN = MetricSpec("wmean", value="v", weight="w"), MetricSpec("hmean", value="v", weight="w")
SHARE = MetricSpec("share", numerator="w", denominator="v", min_denominator=25)
AT = cell_sql("<grid_values>", RES)
NEXT = "(SELECT * EXCLUDE (up), up AS cell FROM {})"


def at_cells(t, name: str = "grid_values", res: int = RES) -> DataFrame:  # noqa: ANN001
    return cells.with_cell(t(name), "x", "y", res)


def level_sql(base: str) -> str:
    """Rows of a base level once for each level: res and cell."""
    parts = [f"SELECT {RES} AS res, * FROM {base}"] + [f"SELECT {r} AS res, * FROM {NEXT.format(parent_sql(base, RES, r).replace(' AS cell', ' AS cell'))}" for r in UP]
    return "(" + " UNION ALL BY NAME ".join(p.replace("* EXCLUDE (up), up AS cell", "* EXCLUDE (up, cell), up AS cell") for p in parts) + ")"


@query("parse_value", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 10 = 0 THEN 0.0 WHEN l_orderkey % 10 IN (1, 2) THEN NULL ELSE l_quantity END::DOUBLE AS v FROM lineitem")
def parse_value(t):  # noqa: ANN001, ANN201
    return t("grid_rows").select("l_orderkey", "l_linenumber", "l_partkey", values.parse_value(F.col("value_text"), ("-1",)).alias("v"))


@query("parse_grid_id", "SELECT DISTINCT grid_id, 100 AS resolution_m, north, east FROM <grid_rows>")
def parse_grid_id(t):  # noqa: ANN001, ANN201
    g = t("grid_rows").select("grid_id").distinct().withColumn("g", values.parse_grid_id(F.col("grid_id")))
    return g.select("grid_id", "g.resolution_m", "g.north", "g.east")


@query("grid_centroid", "SELECT DISTINCT grid_id, (east + 50)::DOUBLE AS x, (north + 50)::DOUBLE AS y FROM <grid_rows>")
def grid_centroid(t):  # noqa: ANN001, ANN201
    x, y = values.grid_centroid(values.parse_grid_id(F.col("grid_id"), strict=True))
    return t("grid_rows").select("grid_id").distinct().select("grid_id", x.alias("x"), y.alias("y"))


@query("coordinate_filter", "SELECT l_linenumber, count(*) FILTER (x <> 0 AND y <> 0) AS kept, count(*) - count(*) FILTER (x <> 0 AND y <> 0) AS dropped FROM (SELECT l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN 0 WHEN l_orderkey % 17 = 0 THEN NULL ELSE x END AS x, y FROM <grid_values>) GROUP BY l_linenumber")
def coordinate_filter(t):  # noqa: ANN001, ANN201
    k = F.col("l_orderkey")
    g = t("grid_values").withColumn("x", F.when(k % 13 == 0, 0.0).when(k % 17 == 0, None).otherwise(F.col("x")))
    good = values.usable_coordinates(F.col("x"), F.col("y"))
    return g.groupBy("l_linenumber").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


@query("point_to_cell", f"SELECT DISTINCT grid_id, cell FROM {AT}")
def point_to_cell(t):  # noqa: ANN001, ANN201
    return at_cells(t).select("grid_id", "cell").distinct()


@query("cell_parent", f"SELECT DISTINCT cell, up AS parent FROM {parent_sql(AT, RES, 7)}")
def cell_parent(t):  # noqa: ANN001, ANN201
    return at_cells(t).select("cell").distinct().transform(cells.with_parent, "cell", RES, 7)


@query("cell_area", "SELECT res, count(DISTINCT cell) AS cells, round(any_value(area), 6) AS km2 FROM (" + " UNION ALL ".join(f"SELECT {r} AS res, cell, {cells.area_km2(r)!r}::DOUBLE AS area FROM {cell_sql('<grid_values>', r)}" for r in (9, 8, 7)) + ") GROUP BY res")
def cell_area(t):  # noqa: ANN001, ANN201
    parts = [at_cells(t, res=r).select(F.lit(r).alias("res"), "cell") for r in (9, 8, 7)]
    area = F.when(F.col("res") == 9, cells.area_km2(9)).when(F.col("res") == 8, cells.area_km2(8)).otherwise(cells.area_km2(7))
    return parts[0].union(parts[1]).union(parts[2]).distinct().groupBy("res").agg(F.count("*").alias("cells")).withColumn("km2", F.round(area, 6))


def pooled(name: str, spec: MetricSpec, text: str) -> None:
    @query(name, f"SELECT cell, {text} FROM {AT} GROUP BY cell HAVING {{}} ".format("count(v) > 0" if spec.rule in ("sum", "mean") else "count(CASE WHEN v IS NOT NULL AND w > 0 THEN 1 END) > 0" if spec.rule == "wmean" else "count(CASE WHEN v > 0 AND w > 0 THEN 1 END) > 0" if spec.rule == "hmean" else "count(CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN 1 END) > 0"))
    def run(t):  # noqa: ANN001, ANN202
        return pool.pool(at_cells(t), spec, ["cell"]).select("cell", F.round(pool.finish(spec), 6).alias("value"))


BOTH = "FILTER (v IS NOT NULL AND w IS NOT NULL)"
pooled("pool_sum", SUM, "round(sum(v), 6) AS value")
pooled("pool_weighted_mean", WMEAN, "round(sum(v * w) FILTER (w > 0) / sum(w) FILTER (w > 0 AND v IS NOT NULL), 6) AS value")
pooled("pool_harmonic_mean", HMEAN, "round(sum(w) FILTER (v > 0 AND w > 0) / sum(w / v) FILTER (v > 0 AND w > 0), 6) AS value")
pooled("pool_share", SHARE, f"CASE WHEN sum(v) {BOTH} >= 25 THEN round(sum(w) {BOTH} / sum(v) {BOTH}, 6) END AS value")
pooled("pool_mean", MEAN, "round(avg(v), 6) AS value")

CATEGORIES = ["c0", "c1", "c2", "c3"]
LONG = " UNION ALL ".join(f"SELECT cell, {i} AS category, {c} AS n FROM {cell_sql('<category_rows>', RES)} WHERE {c} > 0" for i, c in enumerate(CATEGORIES))
SUMS = f"(SELECT cell, category, sum(n) AS n FROM ({LONG}) GROUP BY cell, category)"


@query("pool_category", f"SELECT cell, category, round(n / total, 6) AS dominance, total FROM (SELECT *, sum(n) OVER (PARTITION BY cell) AS total, row_number() OVER (PARTITION BY cell ORDER BY n DESC, category) AS k FROM {SUMS}) WHERE k = 1")
def pool_category(t):  # noqa: ANN001, ANN201
    counts = pool.pool_categories(at_cells(t, "category_rows"), CATEGORIES, ["cell"])
    return pool.dominant(counts, ["cell"]).withColumn("dominance", F.round("dominance", 6))


@query("class_shares", f"SELECT cell, round(coalesce(sum(n) FILTER (category IN (0, 2)), 0) / sum(n), 6) AS artificial_share, arg_max(category, n * 100 - category) AS dominant, round(max(n) / sum(n), 6) AS dominance FROM {SUMS} GROUP BY cell")
def class_shares(t):  # noqa: ANN001, ANN201
    counts = pool.pool_categories(at_cells(t, "category_rows"), CATEGORIES, ["cell"])
    out = pool.class_shares(counts, [0, 2], ["cell"])
    return out.withColumn("artificial_share", F.round("artificial_share", 6)).withColumn("dominance", F.round("dominance", 6))


@query("dominance_u8", f"SELECT cell, round_even(max(n) / sum(n) * 255, 0)::INT AS dominance FROM {SUMS} GROUP BY cell")
def dominance_u8(t):  # noqa: ANN001, ANN201
    counts = pool.pool_categories(at_cells(t, "category_rows"), CATEGORIES, ["cell"])
    return pool.dominant(counts, ["cell"]).select("cell", F.bround(F.col("dominance") * 255).cast("int").alias("dominance"))


@query("pool_counts", f"SELECT cell, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2, sum(c3) AS c3 FROM {cell_sql('<category_rows>', RES)} GROUP BY cell")
def pool_counts(t):  # noqa: ANN001, ANN201
    return pool.pool_counts(at_cells(t, "category_rows"), CATEGORIES, ["cell"])


BASE = f"(SELECT cell, sum(v) AS num, count(v) AS den FROM {AT} GROUP BY cell HAVING count(v) > 0)"
LEVELS = f"(SELECT res, cell, sum(num) AS num, sum(den) AS den FROM {level_sql(BASE)} GROUP BY res, cell)"


def base_levels(t, spec: MetricSpec = SUM) -> DataFrame:  # noqa: ANN001
    return pool.rollup(pool.pool(at_cells(t), spec, ["cell"]), RES, UP)


@query("rollup_levels", f"SELECT res, cell, num AS total, round(num / den, 6) AS mean FROM {LEVELS}")
def rollup_levels(t):  # noqa: ANN001, ANN201
    out = base_levels(t, MEAN)
    return out.select("res", "cell", F.col("num").alias("total"), F.round(pool.finish(MEAN), 6).alias("mean"))


@query("sum_invariant", f"SELECT 'v' AS metric, max(s) AS total, min(s) = max(s) AS same FROM (SELECT res, sum(num) AS s FROM {LEVELS} GROUP BY res)")
def sum_invariant(t):  # noqa: ANN001, ANN201
    return stats.sum_invariant(base_levels(t).withColumn("metric", F.lit("v")), "num", ["metric"])


PICK = lambda p: f"round_even(coalesce(max(v) FILTER (k = least(n - 1, floor(n * {p}))), 0), 4)"
STATS = "SELECT {keys}, count(v) AS n, round_even(coalesce(min(v), 0), 4) AS min, round_even(coalesce(max(v), 0), 4) AS max, {q}, round_even(coalesce(sum(v), 0), 4) AS sum FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v NULLS LAST) - 1 AS k, count(v) OVER (PARTITION BY {keys}) AS n FROM {src}) GROUP BY {keys}"


def stats_sql(src: str, keys: str) -> str:
    return STATS.format(keys=keys, src=src, q=", ".join(f"{PICK(p)} AS {n}" for n, p in stats.QUANTILES.items()))


@query("compute_stats", stats_sql(f"(SELECT res, num AS v FROM {LEVELS})", "res"))
def compute_stats(t):  # noqa: ANN001, ANN201
    return stats.compute_stats(base_levels(t), "num", ["res"], with_sum=True)


@query("nil_share", "SELECT l_linenumber, count(*) FILTER (value_text = '–') AS nil, count(*) FILTER (value_text NOT IN ('–', '.', '-1')) AS numeric FROM <grid_rows> GROUP BY l_linenumber")
def nil_share(t):  # noqa: ANN001, ANN201
    text = F.col("value_text")
    number = values.parse_value(text, ("-1",)).isNotNull() & ~values.is_nil(text)
    return t("grid_rows").groupBy("l_linenumber").agg(F.count_if(values.is_nil(text)).alias("nil"), F.count_if(number).alias("numeric"))


@query("clip_share", f"SELECT res, round(avg((num < 200)::INT), 6) AS below, round(avg((num > 1000)::INT), 6) AS above FROM {LEVELS} GROUP BY res")
def clip_share(t):  # noqa: ANN001, ANN201
    out = stats.clip_share(base_levels(t), "num", 200, 1000, ["res"])
    return out.select("res", F.round("below", 6).alias("below"), F.round("above", 6).alias("above"))


@query("scale_to_total", f"SELECT cell, round(num * 1000000.0 / (SELECT sum(num) FROM {BASE}), 6) AS scaled FROM {BASE}")
def scale_to_total(t):  # noqa: ANN001, ANN201
    out = pool.scale_to_total(pool.pool(at_cells(t), SUM, ["cell"]), "num", 1_000_000.0)
    return out.select("cell", F.round("scaled", 6).alias("scaled"))


UNIVERSE = f"(SELECT DISTINCT res, cell FROM {LEVELS})"
ODD = "(SELECT * FROM <grid_values> WHERE l_orderkey % 3 = 0)"
PART = f"(SELECT cell, sum(v) AS value FROM {cell_sql(ODD + ' AS o', RES)} GROUP BY cell HAVING count(v) > 0)"
WEIGHTS = "(SELECT grid_id, arg_max(weight, seq) AS weight FROM <weight_rows> WHERE weight IS NOT NULL GROUP BY grid_id)"


def universe(t) -> DataFrame:  # noqa: ANN001
    return base_levels(t).select("res", "cell")


def part_of(t, keep) -> DataFrame:  # noqa: ANN001
    out = pool.pool(at_cells(t).filter(keep), SUM, ["cell"])
    return out.select(F.lit(RES).alias("res"), "cell", F.col("num").alias("value"))


@query("align_universe", f"SELECT u.res, u.cell, p.value FROM {UNIVERSE} u LEFT JOIN (SELECT {RES} AS res, * FROM {PART}) p USING (res, cell)")
def align_universe(t):  # noqa: ANN001, ANN201
    return align.align(universe(t), part_of(t, F.col("l_orderkey") % 3 == 0))


@query("align_zero_fill", f"SELECT u.res, u.cell, coalesce(p.value, 0.0) AS value FROM {UNIVERSE} u LEFT JOIN (SELECT {RES} AS res, * FROM {PART}) p USING (res, cell)")
def align_zero_fill(t):  # noqa: ANN001, ANN201
    return align.align(universe(t), part_of(t, F.col("l_orderkey") % 3 == 0), "zero")


OUTSIDE = f"(SELECT {RES} AS res, cell, num AS value FROM {BASE} WHERE cell NOT IN (SELECT cell FROM {PART}))"


@query("dropped_cells", f"SELECT res, cell, value FROM {OUTSIDE}")
def dropped_cells(t):  # noqa: ANN001, ANN201
    return align.dropped_cells(part_of(t, F.lit(True)), part_of(t, F.col("l_orderkey") % 3 == 0))


@query("universe_except", f"SELECT res, cell FROM {OUTSIDE}")
def universe_except(t):  # noqa: ANN001, ANN201
    return align.universe_except(part_of(t, F.lit(True)), part_of(t, F.col("l_orderkey") % 3 == 0))


@query("universe_union", f"SELECT DISTINCT {RES} AS res, cell FROM {cell_sql('(SELECT * FROM <grid_values>) AS o', RES)} WHERE v IS NOT NULL")
def universe_union(t):  # noqa: ANN001, ANN201
    return align.universe_union([part_of(t, F.col("l_orderkey") % 3 == k) for k in (0, 1, 2)])


@query("universe_order", f"SELECT res, cell, row_number() OVER (PARTITION BY res ORDER BY cell) - 1 AS ord FROM {UNIVERSE}")
def universe_order(t):  # noqa: ANN001, ANN201
    return align.universe_order(universe(t))


@query("join_weights", f"SELECT l_linenumber, count(*) AS rows, count(weight) AS matched, sum(weight) AS total FROM <grid_rows> LEFT JOIN {WEIGHTS} USING (grid_id) GROUP BY l_linenumber")
def join_weights(t):  # noqa: ANN001, ANN201
    out = align.join_weights(t("grid_rows"), align.last_weights(t("weight_rows"), "grid_id", "weight", "seq"), "grid_id")
    return out.groupBy("l_linenumber").agg(F.count("*").alias("rows"), F.count("weight").alias("matched"), F.sum("weight").alias("total"))


@query("step_intersect", "SELECT step FROM (SELECT 2000 + step_no AS step, kind AS series FROM <metrics>) GROUP BY step HAVING count(DISTINCT series) = (SELECT count(DISTINCT kind) FROM <metrics>)")
def step_intersect(t):  # noqa: ANN001, ANN201
    return align.step_intersect(t("metrics").select((F.col("step_no") + 2000).alias("step"), F.col("kind").alias("series")))
