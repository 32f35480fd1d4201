"""The census: ten metrics from published grid files, pooled to four levels, aligned to one universe and published."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import cells, values
from cellweave.operators import pool, publish
from cellweave.operators.pool import MetricSpec
from cellweave.plans import atlas as at
from cellweave.plans.registry import cell_sql, parent_sql, query
from cellweave.sources import files
from cellweave.sources.shared import stored
from cellweave.sources.store import Store, fixed_universe

BASE, UP = 10, [9, 8, 7]


@dataclass(frozen=True)
class Metric:
    """One metric: the file that it is read from, how it is pooled, and the (file, column) of its weights."""

    name: str
    file: str
    spec: MetricSpec
    label: str
    weights: tuple[str, str] | None = None
    missing: tuple[str, ...] = ()
    encoding: str = "UTF-8"


# The ten metrics of the census, by the headers of the published tables. The first one's cells are the universe.
METRICS = (
    Metric("population_2022", "people", MetricSpec("sum", value="Einwohner"), "Population 2022"),
    Metric("population_2011", "people_2011", MetricSpec("sum", value="Einwohner"), "Population 2011", missing=("-1",)),
    Metric("age_mean", "age", MetricSpec("wmean", value="Durchschnittsalter", weight="_weight"), "Average age", ("people", "Einwohner")),
    Metric("homes", "rent", MetricSpec("sum", value="AnzahlWohnungen"), "Rented dwellings"),
    Metric("homes_total", "dwellings", MetricSpec("sum", value="Insgesamt_Wohnungen"), "Dwellings"),
    Metric("rent", "rent", MetricSpec("wmean", value="durchschnMieteQM", weight="AnzahlWohnungen"), "Net cold rent"),
    Metric("heating", "heating", MetricSpec("category", categories=("Gas", "Heizoel", "Fernwaerme")), "Heating energy source", encoding="cp1252"),
    Metric("vacancy_rate", "vacancy", MetricSpec("wmean", value="Leerstandsquote", weight="_weight"), "Vacancy rate", ("dwellings", "Insgesamt_Wohnungen")),
    Metric("homes_new_share", "dwellings", MetricSpec("share", numerator="a2014und_spaeter", denominator="Insgesamt_Wohnungen"), "Built 2014 or later"),
    Metric("household_size", "household", MetricSpec("hmean", value="DurchschnHHGroesse", weight="_weight"), "Average household size", ("people", "Einwohner")),
)


def read_by(spec: MetricSpec) -> list[str]:
    """Columns of the metric's own file."""
    named = (spec.value, spec.weight, spec.numerator, spec.denominator, *spec.categories)
    return [c for c in named if c and c != "_weight"]


def sums_of(spec: MetricSpec, name: str) -> dict[str, Column]:
    """What one row adds to the sums of a metric: two of a scalar rule, one for each category."""
    if spec.rule == "category":
        return {f"{name}_{i}": F.when(F.col(c) > 0, F.col(c)) for i, c in enumerate(spec.categories)}
    num, den = pool.partials(spec)
    return {f"{name}_num": num.cast("double"), f"{name}_den": den.cast("double")}


def finished(m: Metric) -> list[Column]:
    """The metric's columns from its sums: a value, or the dominant category (the first of equals) and its dominance in 255ths."""
    if m.spec.rule != "category":
        return [pool.finish(m.spec, F.col(f"{m.name}_num"), F.col(f"{m.name}_den")).alias(m.name)]
    counts = [F.col(f"{m.name}_{i}") for i in range(len(m.spec.categories))]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in counts[1:]), F.coalesce(counts[0], F.lit(0.0)))
    top = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("i")) for i, c in enumerate(counts)]))
    return [F.when(total > 0, -top["i"]).cast("double").alias(f"{m.name}_category"), F.when(total > 0, F.bround(top["n"] / total * 255)).alias(f"{m.name}_dominance")]


def columns_of(m: Metric) -> dict[str, dict]:
    """Catalog entries of the metric's columns."""
    entry = {"label": m.label, "rule": m.spec.rule}
    if m.spec.rule != "category":
        return {m.name: entry}
    return {f"{m.name}_category": entry | {"categories": list(m.spec.categories)}, f"{m.name}_dominance": entry | {"label": f"{m.label}, dominance"}}


def pooled_sums(spark: SparkSession, paths: dict[str, str], metrics: tuple[Metric, ...]) -> DataFrame:
    """(res, cell, sums): every metric at every level. Metrics of one file, weights and treatment of markers share its scan.

    The grid has about one square for each cell, so rows of all files are dealt out by cell as they are, each with the
    number of its scan and only that scan's sums; all rules and the categories then go through one aggregation. Each
    further level is pooled from the one below it, which is written first.
    """
    scans: dict[tuple, list[Metric]] = {}
    for m in metrics:
        scans.setdefault((m.file, m.weights, m.missing, m.encoding), []).append(m)
    by_grid = {w: stored(files.scan_weights(spark, paths[w[0]], w[1]).withColumnRenamed("weight", "_weight")) for w in dict.fromkeys(m.weights for m in metrics if m.weights)}
    parts, sums = [], {}
    for i, ((file, weights, missing, encoding), own) in enumerate(scans.items()):
        columns = list(dict.fromkeys(c for m in own for c in read_by(m.spec)))
        rows = files.scan_grid_csv(spark, paths[file], columns, encoding=encoding, missing=missing)
        if weights:
            rows = rows.join(by_grid[weights].hint("shuffle_hash"), "grid_id", "left")  # one row for each square
        # after the cell: a filter before it would parse the coordinates a second time
        rows = cells.with_cell(rows, "x", "y", BASE).filter(values.usable_coordinates(F.col("x"), F.col("y")))
        adds = {k: v for m in own for k, v in sums_of(m.spec, m.name).items()}
        sums |= {k: F.sum(F.when(F.col("_scan") == i, F.col(f"_v{j}"))) for j, k in enumerate(adds)}
        parts.append(rows.select("cell", F.lit(i).alias("_scan"), *[v.alias(f"_v{j}") for j, v in enumerate(adds.values())]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    level = stored(rows.repartition("cell").groupBy("cell").agg(*[v.alias(k) for k, v in sums.items()]))
    levels = [level.select(F.lit(BASE).alias("res"), "*")]
    for below, r in zip([BASE, *UP], UP, strict=False):
        up = cells.with_parent(level, "cell", below, r, "_up")
        level = stored(up.groupBy(F.col("_up").alias("cell")).agg(*[F.sum(c).alias(c) for c in sums]))
        levels.append(level.select(F.lit(r).alias("res"), "*"))
    return reduce(DataFrame.unionByName, levels)


def run(store: Store, paths: dict[str, str], metrics: tuple[Metric, ...] = METRICS) -> dict:
    """Pools, aligns and publishes metrics; on a new store the cells of the first one are the universe. Returns the manifest."""
    name = uuid.uuid4().hex
    raw = f"runs/{name}/values"
    pooled_sums(store.spark, paths, metrics).select("res", "cell", *[c for m in metrics for c in finished(m)]).write.parquet(store.at(raw))
    found = store.spark.read.parquet(store.at(raw))
    columns = {c: e for m in metrics for c, e in columns_of(m).items()}
    first = next(iter(columns))
    universe = fixed_universe(store, lambda: publish.described(found.filter(F.col(first).isNotNull()).select("res", "cell"), (BASE, *UP)))
    return publish.publish(store, name, universe.join(found, ["res", "cell"], "left").select(*publish.PLACE, *columns), columns)


# --- the registered run

#: Files, the column of the test census behind each header, and the rows that each holds.
FILES = {
    "people": ({"Einwohner": "people"}, "TRUE"), "people_2011": ({"Einwohner": "people_before"}, "k % 3 <> 0"), "age": ({"Durchschnittsalter": "age"}, "k % 5 <> 0"),
    "rent": ({"durchschnMieteQM": "rent", "AnzahlWohnungen": "rented"}, "k % 7 <> 1"), "dwellings": ({"Insgesamt_Wohnungen": "dwellings", "a2014und_spaeter": "built"}, "k % 11 <> 1"),
    "heating": ({"Gas": "h0", "Heizoel": "h1", "Fernwaerme": "h2"}, "k % 5 <> 1"), "vacancy": ({"Leerstandsquote": "vacancy"}, "k % 4 <> 1"), "household": ({"DurchschnHHGroesse": "household"}, "k % 6 <> 1"),
}


def written_files(t) -> dict[str, str]:  # noqa: ANN001
    """The census as files like the published ones: markers, decimal commas, one in the old encoding, one with centres but no ids."""
    paths = {}
    for file, (columns, keep) in FILES.items():
        rows = t("census_text").filter(keep)
        latin = file == "heating"
        text = lambda c: F.replace(F.col(c), F.lit("–"), F.lit(files.LATIN_DASH)) if latin else F.col(c)  # noqa: B023, E731
        place = [F.col("grid_id").alias("GITTER_ID_100m"), F.col("x").alias("x_mp_100m"), F.col("y").alias("y_mp_100m")]
        paths[file] = at.folder(t, file)
        rows.select(*place[1 if latin else 0 :], *[text(c).alias(header) for header, c in columns.items()]).write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1" if latin else "UTF-8").csv(paths[file])
    return paths


def sum_parts() -> str:
    """SQL of the long form (metric, category, cell, num, den) of every row of ``v``."""
    scalar = {
        "population_2022": ("people", "CASE WHEN people IS NOT NULL THEN 1.0 END", "people"), "population_2011": ("people_before", "CASE WHEN people_before IS NOT NULL THEN 1.0 END", "people_2011"),
        "age_mean": ("CASE WHEN age IS NOT NULL AND people > 0 THEN age * people END", "CASE WHEN age IS NOT NULL AND people > 0 THEN people END", "age"),
        "homes": ("rented", "CASE WHEN rented IS NOT NULL THEN 1.0 END", "rent"), "homes_total": ("dwellings", "CASE WHEN dwellings IS NOT NULL THEN 1.0 END", "dwellings"),
        "rent": ("CASE WHEN rent IS NOT NULL AND rented > 0 THEN rent * rented END", "CASE WHEN rent IS NOT NULL AND rented > 0 THEN rented END", "rent"),
        "vacancy_rate": ("CASE WHEN vacancy IS NOT NULL AND dwellings > 0 AND k % 11 <> 1 THEN vacancy * dwellings END", "CASE WHEN vacancy IS NOT NULL AND dwellings > 0 AND k % 11 <> 1 THEN dwellings END", "vacancy"),
        "homes_new_share": ("CASE WHEN built IS NOT NULL AND dwellings IS NOT NULL THEN built END", "CASE WHEN built IS NOT NULL AND dwellings IS NOT NULL THEN dwellings END", "dwellings"),
        "household_size": ("CASE WHEN household > 0 AND people > 0 THEN people END", "CASE WHEN household > 0 AND people > 0 THEN people / household END", "household"),
    }
    parts = [f"SELECT '{m}' AS metric, NULL::INT AS category, cell, {num} AS num, {den} AS den FROM v WHERE {FILES[file][1]}" for m, (num, den, file) in scalar.items()]
    parts += [f"SELECT 'heating', {i}, cell, h{i}, 1.0 FROM v WHERE h{i} > 0 AND {FILES['heating'][1]}" for i in range(3)]
    return " UNION ALL ".join(parts)


ALL = "['population_2022', 'population_2011', 'age_mean', 'homes', 'homes_total', 'rent', 'heating_category', 'heating_dominance', 'vacancy_rate', 'homes_new_share', 'household_size']"
LEVELS = " UNION ALL ".join(["SELECT 10 AS res, metric, category, cell, num, den FROM base"] + [f"SELECT {r}, metric, category, up, num, den FROM {parent_sql('base', 10, r)}" for r in UP])
VALUES = f"""
WITH v AS (SELECT * FROM {cell_sql('<census_values>', 10)}), part AS ({sum_parts()}),
base AS (SELECT metric, category, cell, sum(num) AS num, sum(den) AS den FROM part GROUP BY ALL HAVING count(den) > 0),
s AS (SELECT res, metric, category, cell, sum(num) AS num, sum(den) AS den FROM ({LEVELS}) GROUP BY ALL),
h AS (SELECT res, cell, arg_max(category, num * 1000 - category) AS top, round_even(max(num) / sum(num) * 255, 0) AS share FROM s WHERE metric = 'heating' GROUP BY ALL),
val AS (SELECT metric, res, cell, CASE WHEN den > 0 THEN CASE WHEN metric IN ('population_2022', 'population_2011', 'homes', 'homes_total') THEN num ELSE num / den END END AS value FROM s WHERE metric <> 'heating'
  UNION ALL SELECT 'heating_category', res, cell, top::DOUBLE FROM h UNION ALL SELECT 'heating_dominance', res, cell, share FROM h),
u AS (SELECT res, cell FROM val WHERE metric = 'population_2022' AND value IS NOT NULL)
"""


@query("job_census", f"{VALUES} SELECT m.metric, u.res, u.cell, val.value FROM u CROSS JOIN (SELECT unnest({ALL}) AS metric) m LEFT JOIN val ON val.metric = m.metric AND val.res = u.res AND val.cell = u.cell")
def job_census(t):  # noqa: ANN001, ANN201
    """Ten metrics from eight files to a published run, read back by its manifest."""
    store = Store(t("region").sparkSession, at.folder(t, "atlas"))
    run(store, written_files(t))
    return publish.published(store)
