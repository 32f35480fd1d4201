"""Distribution statistics and checks of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.shared import stored_in_ranges

QUANTILES = {"p50": 0.5, "p95": 0.95, "p995": 0.995}


def compute_stats(rows: DataFrame, value: str, keys: list[str], with_sum: bool = False, decimals: int = 4) -> DataFrame:
    """min, max and the elements at index least(n - 1, floor(p * n)) of the sorted present values.

    Equal values are counted first and the counts are written once, in sampled
    ranges of (keys, value). Running counts are taken inside the ranges and
    then over them, so no task sorts a whole group, heavy-tailed values
    included. Groups without values give zeros; a null key is a group.
    """
    counted = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_m"))
    counted = stored_in_ranges(counted, *keys, "_v")
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*keys, "_r").agg(F.sum("_m").alias("_t"))
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r").alias("_range"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_below"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_n"),
    )
    inside = F.sum("_m").over(Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col("_r") == F.col("_range"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    placed = counted.withColumn("_c", inside).join(totals, same)
    last = F.col("_below") + F.col("_c")  # 1-based place of the last copy of the value
    pick = {name: F.min(F.when(last > F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)), F.col("_v"))) for name, p in QUANTILES.items()}
    measures = {"min": F.min("_v"), "max": F.max("_v"), **pick, **({"sum": F.sum(F.col("_v") * F.col("_m"))} if with_sum else {})}
    return placed.groupBy(*keys).agg(F.sum("_m").alias("n"), *[F.bround(F.coalesce(m, F.lit(0.0)), decimals).alias(name) for name, m in measures.items()])


def sum_invariant(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, total, same: whether the total is identical at every resolution."""
    by_res = rows.groupBy(*keys, "res").agg(F.sum(value).alias("total"))
    return by_res.groupBy(*keys).agg(F.max("total").alias("total"), (F.min("total") == F.max("total")).alias("same"))


def clip_share(rows: DataFrame, value: str, low: float, high: float, keys: list[str]) -> DataFrame:
    """Share of the present values below and above a colour domain."""
    v = F.col(value)
    return rows.filter(v.isNotNull()).groupBy(*keys).agg(F.avg((v < low).cast("double")).alias("below"), F.avg((v > high).cast("double")).alias("above"))


def coverage_ratio(wanted: DataFrame, ready: DataFrame, previous: DataFrame) -> DataFrame:
    """Share of wanted tiles that are ready, now or in the previous generation; 0 if none is wanted."""
    have = ready.union(previous).distinct().withColumn("_have", F.lit(1.0))
    return wanted.join(have, "tile", "left").agg(F.coalesce(F.avg(F.coalesce("_have", F.lit(0.0))), F.lit(0.0)).alias("coverage"))
