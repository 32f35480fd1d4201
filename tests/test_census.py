"""The census run from files by hand: rules, categories, the fixed universe, and a later run."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from cellweave.functions import cells
from cellweave.operators import publish
from cellweave.operators.pool import MetricSpec
from cellweave.plans import census
from cellweave.plans.census import Metric
from cellweave.sources.store import Store

ID = "CRS3035RES100mN{}E{}"
#: Two squares in one cell of the finest level, one far away.
NEAR, BESIDE, FAR = (3000000, 4300000), (3000000, 4300010), (3100000, 4400000)


def written(path, columns, rows, encoding="utf-8"):
    lines = [";".join(["GITTER_ID_100m", *columns])] + [";".join([ID.format(*square), *values]) for square, values in rows]
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


@pytest.fixture(scope="module")
def atlas(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("census")
    paths = {
        "people": written(folder / "p.csv", ["Einwohner"], [(NEAR, ["1000"]), (BESIDE, ["10"]), (FAR, ["5"])]),
        "age": written(folder / "a.csv", ["Durchschnittsalter"], [(NEAR, ["40,0"]), (BESIDE, ["60,0"]), (FAR, ["/"])]),
        "heating": written(folder / "h.csv", ["Gas", "Heizoel", "Fernwaerme"], [(NEAR, ["70", "30", "–"]), (BESIDE, ["10", "40", "–"]), (FAR, ["5", "5", "."])], "cp1252"),
        "dwellings": written(folder / "d.csv", ["Insgesamt_Wohnungen", "a2014und_spaeter"], [(NEAR, ["10", "10"]), (BESIDE, ["1000", "100"]), ((3200000, 4500000), ["30", "3"])]),
    }
    metrics = tuple(m for m in census.METRICS if m.name in ("population_2022", "age_mean", "heating"))
    store = Store(spark, str(folder / "atlas"))
    census.run(store, paths, metrics)
    return store, paths


def values(store, metric, res=10):
    return sorted((r.value for r in publish.published(store).filter((F.col("metric") == metric) & (F.col("res") == res)).collect()), key=lambda v: (v is None, v))


def test_rules_and_categories_of_one_run(atlas):
    store, _ = atlas
    for res in (10, 9, 8, 7):
        assert values(store, "population_2022", res) == [5.0, 1010.0]
        assert values(store, "age_mean", res) == [pytest.approx(40600 / 1010), None]
        assert values(store, "heating_category", res) == [0.0, 0.0]  # 80 gas against 70 oil; of equals the first
        assert values(store, "heating_dominance", res) == [128.0, 136.0]  # a half, to the even number, and 80 of 150
    _, now = store.head()
    assert list(now["metrics"]["heating_category"]["categories"]) == ["Gas", "Heizoel", "Fernwaerme"] and now["metrics"]["age_mean"]["rule"] == "wmean"
    assert sorted((r.res, r.tiled, r["count"]) for r in publish.table(store, "lods").collect()) == [(7, False, 2), (8, False, 2), (9, True, 2), (10, True, 2)]


def test_a_later_run_keeps_the_universe_and_the_other_metrics(atlas):
    store, paths = atlas
    share = Metric("new", "dwellings", MetricSpec("share", numerator="a2014und_spaeter", denominator="Insgesamt_Wohnungen", min_denominator=25), "New")
    tiles = {(r.res, r.tile): r.metrics for r in publish.tiles(store).collect()}
    census.run(store, paths, (share,))
    assert values(store, "new") == [pytest.approx(110 / 1010), None]  # the third square is outside, the far one has no dwellings
    assert values(store, "population_2022") == [5.0, 1010.0]
    for r in publish.tiles(store).collect():
        assert {m: v for m, v in r.metrics.items() if m != "new"} == tiles[r.res, r.tile]
    assert {m for r in publish.tiles(store).collect() for m in r.metrics} == {"population_2022", "age_mean", "heating_category", "heating_dominance", "new"}
    assert {(r.metric, r.n) for r in publish.table(store, "stats").filter("res = 9").collect()} == {("population_2022", 2), ("age_mean", 1), ("heating_category", 2), ("heating_dominance", 2), ("new", 1)}


def test_ancestors_of_many_steps_are_compiled_and_equal_single_steps(spark):
    rows = spark.range(40000).select((F.col("id") % 200 * 100.0 + 4200050).alias("x"), (F.floor(F.col("id") / 200) * 100.0 + 2800050).alias("y"))
    rows = cells.with_cell(rows, "x", "y", 10).select("cell").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    for to in (7, 6, 5):
        single = rows.select("cell", F.col("cell").alias("p"))
        for r in range(10, to, -1):
            single = cells.with_parent(single, "p", r, r - 1, "p")
        both = cells.with_parent(single, "cell", 10, to, "q")
        assert both.filter(~F.col("p").eqNullSafe(F.col("q"))).isEmpty() and both.filter("q is null").count() == 1
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        cells.with_parent(rows, "cell", 10, 5, "q").explain("codegen")
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", printed.getvalue()))  # the JVM compiles no larger method; this one had 10,242 bytes


def test_a_square_without_usable_coordinates_is_left_out_of_the_pooling(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("GITTER_ID_100m;x_mp_100m;y_mp_100m;Einwohner\na;4300050;3000050;7\nb;0;3000050;8\nc;4300050;0;9\nd;x;.;10\n")
    sums = census.pooled_sums(spark, {"people": str(path)}, census.METRICS[:1])
    assert sorted((r.res, r.population_2022_num, r.population_2022_den) for r in sums.collect()) == [(r, 7.0, 1.0) for r in (7, 8, 9, 10)]
