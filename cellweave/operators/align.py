"""One fixed set of cells for all metrics: order, alignment, and what falls outside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.shared import stored_in_ranges


def universe_union(parts: list[DataFrame]) -> DataFrame:
    """Distinct (res, cell) of all parts."""
    return reduce(DataFrame.unionByName, [p.select("res", "cell") for p in parts]).distinct()


def universe_order(universe: DataFrame) -> DataFrame:
    """Adds ord: the 0-based place of the cell among the sorted cells of its resolution.

    The cells are written once in sampled ranges of ids, numbered inside them,
    and the ranges are then put end to end, so no task sorts a whole resolution.
    """
    parts = stored_in_ranges(universe, "res", "cell")
    sizes = parts.groupBy("res", "_r").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("res").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("res", "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("res", "_r").orderBy("cell"))
    return parts.withColumn("_i", inside).join(sizes, ["res", "_r"]).withColumn("ord", F.col("_before") + F.col("_i") - 1).drop("_r", "_i", "_before")


def align(universe: DataFrame, metric: DataFrame, fill: str = "null", value: str = "value") -> DataFrame:
    """One row for each cell of the universe; absent cells get NULL or zero, as the metric declares."""
    out = universe.join(metric, ["res", "cell"], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0))) if fill == "zero" else out


def dropped_cells(metric: DataFrame, universe: DataFrame) -> DataFrame:
    """Cells of the metric outside the universe."""
    return metric.join(universe.select("res", "cell"), ["res", "cell"], "left_anti")


def universe_except(cells: DataFrame, universe: DataFrame) -> DataFrame:
    return cells.select("res", "cell").subtract(universe.select("res", "cell"))


def join_weights(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Weight from a second table; without a match NULL."""
    return rows.join(weights, key, "left")


def last_weights(rows: DataFrame, key: str, weight: str, order: str) -> DataFrame:
    """One weight for each key: of several the last one, missing ones aside."""
    return rows.filter(F.col(weight).isNotNull()).groupBy(key).agg(F.max_by(weight, order).alias(weight))


def step_intersect(metrics: DataFrame) -> DataFrame:
    """Steps that every series has."""
    series = metrics.select("series").distinct().agg(F.count("*").alias("_all"))
    return metrics.groupBy("step").agg(F.countDistinct("series").alias("_n")).join(F.broadcast(series), F.col("_n") == F.col("_all")).select("step")
