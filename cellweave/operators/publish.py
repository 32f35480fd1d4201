"""Publishing runs: levels, tiles, tile index, statistics, and at last the manifest that names them.

A store holds ``universe`` (fixed by the first run), ``runs/<run>/levels`` (one row for each cell of the universe, one column for
each metric), ``tiles`` (one file for each tile of the fine levels, folded together from all runs), ``index``, ``stats`` and ``lods``
(merged tables, a new one for each run) and ``manifests``. A run that dies leaves the newest manifest as it was.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import cells
from cellweave.operators import align, catalog, stats
from cellweave.sources.store import Store

PLACE = ("res", "cell", "ord", "tile", "lon", "lat")
TILED = (9, 10)
TILE = "count int, cells array<bigint>, lon array<double>, lat array<double>, metrics map<string, array<double>>, res int, tile bigint"


def described(cells_: DataFrame, resolutions: tuple[int, ...], tiled: tuple[int, ...] = TILED) -> DataFrame:
    """(res, cell) -> order, tile (none where the level isn't cut) and centre in metres of every cell.

    Only ids are put in order; the rest is taken from them afterwards.
    """
    rows = align.universe_order(cells_.filter(F.col("res").isin(*resolutions)).select(F.col("res").cast("int").alias("res"), "cell"))
    cut = [r for r in resolutions if r in tiled]
    for r in cut:
        rows = cells.with_parent(rows, "cell", r, cells.TILE_RES, f"_t{r}")
    by_res = lambda of: F.coalesce(*[F.when(F.col("res") == r, of(r)) for r in resolutions])
    x, y = (by_res(lambda r, i=i: F.round(cells.centre(F.col("cell"), r)[i], 6)) for i in (0, 1))
    tile = F.coalesce(F.lit(None).cast("long"), *[F.when(F.col("res") == r, F.col(f"_t{r}")) for r in cut])
    return rows.select("res", "cell", "ord", tile.alias("tile"), x.alias("lon"), y.alias("lat")).select(*PLACE)


def tiles(store: Store) -> DataFrame:
    return store.spark.read.schema(TILE).parquet(store.at("tiles"))


def entries(metrics: Column) -> Column:
    return F.array_sort(F.map_entries(metrics))


def fold_tiles(store: Store, levels: DataFrame, metrics: list[str]) -> None:
    """Folds metrics of rows with a tile into the tiles' files: other metrics stay, and only tiles that change are written.

    A tile's arrays follow the universe's order. A metric that a tile has no value of isn't put into it.
    A cell without position is an error.
    """
    there = F.assert_true(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.lit("a cell has no position"))
    rows = levels.filter("tile is not null").withColumn("_ok", there).filter("_ok is null")
    packed = rows.groupBy("res", "tile").agg(F.array_sort(F.collect_list(F.struct("ord", "cell", "lon", "lat", *[F.col(m).cast("double").alias(m) for m in metrics]))).alias("p"))
    array = lambda c: F.transform("p", lambda x: x[c])
    new = packed.select("res", "tile", F.size("p").alias("count"), array("cell").alias("cells"), array("lon").alias("lon"), array("lat").alias("lat"), F.create_map(*[x for m in metrics for x in (F.lit(m), array(m))]).alias("metrics"))
    none = F.create_map().cast("map<string, array<double>>")
    if store.exists("tiles"):
        old = tiles(store).select("res", "tile", *[F.col(c).alias(f"_{c}") for c in ("count", "cells", "lon", "lat", "metrics")])
        new = new.join(old, ["res", "tile"], "left")
    else:
        new = new.withColumns({"_cells": F.lit(None).cast("array<bigint>"), "_lon": F.lit(None).cast("array<double>"), "_lat": F.lit(None).cast("array<double>"), "_metrics": F.lit(None).cast("map<string, array<double>>")})
    had = F.coalesce("_metrics", none)
    own = F.map_filter("metrics", lambda k, v: F.exists(v, lambda x: x.isNotNull()) | F.map_contains_key(had, k))
    kept = F.map_filter(had, lambda k, v: ~k.isin(metrics))
    new = new.withColumn("metrics", F.map_concat(kept, own))
    same = F.col("_cells").isNotNull() & (entries(F.col("metrics")) == entries(had))
    for c in ("cells", "lon", "lat"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = new.filter(~F.coalesce(same, F.lit(False))).select("count", "cells", "lon", "lat", "metrics", "res", "tile")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("res", "tile").parquet(store.at("tiles"))


def merged(store: Store, old: str | None, new: DataFrame, keys: list[str], kind: str) -> str:
    """Name of a new table: ``new`` and the rows of the old one whose keys it doesn't have."""
    table = new if old is None else catalog.upsert(store.spark.read.parquet(store.at(old)), new, keys)
    name = f"{kind}/{uuid.uuid4().hex}"
    table.write.parquet(store.at(name))
    return name


def publish(store: Store, run: str, levels: DataFrame, metrics: dict[str, dict]) -> dict:
    """Publishes the metrics (name -> what the catalog says of it) of one run and returns the manifest.

    ``levels`` has the columns of the universe and one for each metric. If another run has published
    meanwhile, its metrics are folded in again too, from its levels: both may have rewritten the same tiles.
    """
    _, base = store.head()
    names, path = list(metrics), f"runs/{run}/levels"
    levels.write.partitionBy("res").parquet(store.at(path))
    read = lambda at: store.spark.read.parquet(store.at(at))
    levels = read(path)
    long = levels.unpivot(["res"], names, "metric", "value")
    measured = stats.compute_stats(long, "value", ["res", "metric"], with_sum=True)
    index = levels.filter("tile is not null").groupBy("res", "tile").agg(*catalog.extent())
    known = {m: e for m, e in base.get("metrics", {}).items()}

    def change(now: dict) -> dict:
        have = now.get("metrics", {})
        for at in {e["levels"] for m, e in have.items() if known.get(m) != e and m not in metrics}:
            fold_tiles(store, read(at), [m for m, e in have.items() if e["levels"] == at and m not in metrics])
        fold_tiles(store, levels, names)
        return now | {
            "run": run,
            "index": merged(store, now.get("index"), index, ["res", "tile"], "index"),
            "stats": merged(store, now.get("stats"), measured, ["res", "metric"], "stats"),
            "lods": merged(store, now.get("lods"), catalog.lod_table(levels.select("res", "lon", "lat")), ["res"], "lods"),
            "metrics": have | {m: {**metrics[m], "levels": path, "run": run} for m in names},
        }

    return store.commit(change)


def table(store: Store, kind: str) -> DataFrame:
    """The merged index, stats or lods of the newest manifest."""
    return store.spark.read.parquet(store.at(store.head()[1][kind]))


def published(store: Store) -> DataFrame:
    """(metric, res, cell, value) of every metric of the newest manifest, each from the run that published it last."""
    _, now = store.head()
    by: dict[str, list[str]] = {}
    for m, e in now["metrics"].items():
        by.setdefault(e["levels"], []).append(m)
    parts = [store.spark.read.parquet(store.at(at)).unpivot(["res", "cell"], names, "metric", "value") for at, names in by.items()]
    return reduce(DataFrame.unionByName, parts)
