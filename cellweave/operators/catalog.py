"""The catalog of datasets, levels, tiles and metrics, and what a view takes from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import cells

# Display order, fields that provenance must and should have, minimum zoom of census levels.
DATASETS = ("zensus", "afterdark", "energy", "rain", "land", "forest")
REQUIRED = ("sourceUrl", "pipelineVersion", "gitCommit", "generatedAt")
WANTED = ("sourceHash", "downloadDate")
CENSUS_ZOOM, FINE_ZOOM = {9: 7.0, 10: 10.2}, 7.0
CHANGE, CHANGE_NEEDS = "change_pct", ("population_2022", "population_2011")


def extent() -> list[Column]:
    """count and bounds, as aggregates of lon and lat."""
    ends = (("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))
    return [F.count("*").alias("count"), *[F.round(f(c), 3).alias(n) for n, f, c in ends]]


def tile_index(positions: DataFrame, tile: str = "tile") -> DataFrame:
    """count and bounds of each tile."""
    return positions.groupBy(tile).agg(*extent())


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of both, replaced by key where the new side has them."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_run").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def merge_metrics(runs: DataFrame) -> DataFrame:
    """Runs (run, dataset, metric, label) -> the newest run's entry of each metric."""
    return runs.groupBy("dataset", "metric").agg(F.max_by("label", "run").alias("label"), F.max("run").alias("run"))


def merge_levels(runs: DataFrame) -> DataFrame:
    """Runs -> (dataset, res, stats): levels by resolution; statistics of all metrics accumulate, the newest of each stays."""
    newest = runs.groupBy("dataset", "res", "metric").agg(F.max_by("top", "run").alias("top"))
    entries = F.array_sort(F.collect_list(F.struct("metric", "top")))
    return newest.groupBy("dataset", "res").agg(F.map_from_entries(entries).alias("stats"))


def reference_dates(runs: DataFrame) -> DataFrame:
    """The newest date by text, not the last one written."""
    return runs.groupBy("dataset").agg(F.max("reference_date").alias("reference_date"))


def min_zoom(res: Column, census: bool, coarsest: Column) -> Column:
    if census:
        return F.when(res <= 8, 0.0).when(res == 9, CENSUS_ZOOM[9]).otherwise(CENSUS_ZOOM[10])
    return F.when(res == coarsest, 0.0).otherwise(FINE_ZOOM)


def lod_table(positions: DataFrame, census: bool = True, tiled_from: int = 9) -> DataFrame:
    """Per resolution: count, bounds, edge, minimum zoom, whether it is cut in tiles."""
    out = tile_index(positions, "res")
    edge = F.coalesce(*[F.when(F.col("res") == r, e) for r, e in cells.EDGE_METRES.items()])
    coarsest = F.broadcast(out.agg(F.min("res").alias("_least")))
    return out.join(coarsest).select(*out.columns, edge.alias("edge_metres"), min_zoom(F.col("res"), census, F.col("_least")).alias("min_zoom"), (F.col("res") >= tiled_from).alias("tiled"))


def atlas_catalog(datasets: DataFrame, order: tuple[str, ...] = DATASETS) -> DataFrame:
    """Datasets of the display order with their place in it; absent ones are skipped."""
    place = F.array_position(F.array(*[F.lit(d) for d in order]), F.col("dataset"))
    return datasets.withColumn("place", place.cast("long") - 1).filter("place >= 0")


def rolled_digest(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lines, digest) of a column line, whatever the order of the rows.

    Each line has its own SHA-256 and its number of copies. Lines whose digests
    share six hex digits are digested in sorted order, those that share three
    digits again, then all of a group: no step gathers a whole folder.
    """
    counted = lines.groupBy(*keys, F.sha2("line", 256).alias("_h")).agg(F.count("*").alias("lines"))
    out = counted.withColumn("_d", F.concat("_h", F.lit(":"), F.col("lines").cast("string")))
    for digits in (6, 3, 0):
        one = F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), "\n"), 256)
        out = out.groupBy(*keys, F.substring("_h", 1, digits).alias("_h")).agg(F.sum("lines").alias("lines"), one.alias("_d"))
    return out.select(*keys, "lines", F.col("_d").alias("digest"))


def level_stamp(files: DataFrame, keys: list[str], described_in: str = "index.json") -> DataFrame:
    """Version of each level: ten digits of the rolled digest of names, sizes and times of its files but the description."""
    line = F.concat_ws(":", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    rolled = rolled_digest(files.filter(F.col("name") != described_in).select(*keys, line.alias("line")), keys)
    return rolled.select(*keys, F.substring("digest", 1, 10).alias("stamp"))


def input_fingerprint(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, digest) -> one file's own digest; of several the rolled digest over path and digest."""
    line = F.concat("path", F.lit("\u0000"), "digest")
    own = files.groupBy(*keys).agg(F.min("digest").alias("_own"))
    rolled = rolled_digest(files.select(*keys, line.alias("line")), keys)
    out = rolled.join(own, keys)
    return out.select(*keys, F.col("lines").cast("int").alias("files"), F.when(F.col("lines") == 1, F.col("_own")).otherwise(F.col("digest")).alias("fingerprint"))


def provenance_audit(sources: DataFrame) -> DataFrame:
    """status FAIL, thin or ok, and gaps, of datasets with the provenance fields as columns; empty text is absent."""
    gaps = lambda names: F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in names]), lambda g: g.isNotNull())
    status = F.when(F.size(gaps(REQUIRED)) > 0, "FAIL").when(F.size(gaps(WANTED)) > 0, "thin").otherwise("ok")
    return sources.select("dataset", status.alias("status"), F.array_join(F.concat(gaps(REQUIRED), gaps(WANTED)), ", ").alias("gaps"))


def bind_modes(modes: DataFrame, metrics: DataFrame) -> DataFrame:
    """(dataset, mode, steps, last_step, timeline): steps for which every template of a mode exists in a dataset.

    ``modes`` has one row for each (mode, template, step), ``{step}`` in templates; a timeline needs two steps.
    """
    wanted = modes.withColumn("metric", F.replace("template", F.lit("{step}"), F.col("step").cast("string")))
    need = modes.groupBy("mode").agg(F.countDistinct("template").alias("_need"))
    have = wanted.join(metrics.select("dataset", "metric").distinct(), "metric").groupBy("dataset", "mode", "step").agg(F.countDistinct("template").alias("_have"))
    good = have.join(F.broadcast(need), "mode").filter("_have = _need")
    return good.groupBy("dataset", "mode").agg(F.count("*").alias("steps"), F.max("step").alias("last_step"), (F.count("*") >= 2).alias("timeline"))


def required_metrics(needs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Distinct (dataset, mode, metric) that modes read and datasets have. ``needs`` has (mode, metric)."""
    return needs.join(metrics.select("dataset", "metric").distinct(), "metric").select("dataset", "mode", "metric").distinct()


def modes_served(needs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(dataset, mode) whose every needed metric exists; the derived change needs both its years instead."""
    years = F.when(F.col("metric") == CHANGE, F.array(*[F.lit(m) for m in CHANGE_NEEDS])).otherwise(F.array("metric"))
    needs = needs.select("mode", F.explode(years).alias("metric")).distinct()
    total = needs.groupBy("mode").agg(F.count("*").alias("_all"))
    have = required_metrics(needs, metrics).groupBy("dataset", "mode").agg(F.count("*").alias("_have"))
    return have.join(F.broadcast(total), "mode").filter("_have = _all").select("dataset", "mode")


def write_tiles(rows: DataFrame, path: str) -> None:
    """Parquet by resolution and tile, in universe order; tiles cut the universe without rest."""
    rows.repartition("res", "tile").sortWithinPartitions("res", "tile", "ord").write.partitionBy("res", "tile").parquet(path)


def tile_places(universe: DataFrame) -> DataFrame:
    """Adds the 0-based place of a cell inside its tile, in universe order."""
    return universe.withColumn("place", F.row_number().over(Window.partitionBy("res", "tile").orderBy("ord")) - 1)
