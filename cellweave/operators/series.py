"""Steps of time, changes between them, parts put end to end, and comparison with published blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_pct(before: Column, now: Column, least: float = 25.0) -> Column:
    """Relative change; NULL if a side is missing or the baseline is small."""
    return F.when(before.isNotNull() & now.isNotNull() & (before >= least), (now - before) / before)


def join_two_steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(res, cell, before, now) of cells that both steps have."""
    keys = ["res", "cell"]
    return a.select(*keys, F.col("value").alias("before")).join(b.select(*keys, F.col("value").alias("now")), keys)


def relative_change(before: DataFrame, now: DataFrame, least: float = 0.5) -> DataFrame:
    """Change of every present cell of the current step; NULL where the baseline is missing or small."""
    keys = ["res", "cell"]
    both = now.filter("value is not null").select(*keys, F.col("value").alias("now")).join(before.select(*keys, F.col("value").alias("before")), keys, "left")
    return both.withColumn("change", change_pct(F.col("before"), F.col("now"), least))


def yearly_delta(rows: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Difference from the step before, per cell."""
    w = Window.partitionBy(*keys).orderBy(step)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w))


def last_step(rows: DataFrame, series: str, step: str) -> DataFrame:
    return rows.groupBy(series).agg(F.max(step).alias("last_step"))


def part_offsets(parts: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Start of each part, and the total, when the parts of a group are put end to end."""
    w = Window.partitionBy(group).orderBy(order)
    start = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("offset", start).withColumn("total", F.sum(length).over(Window.partitionBy(group)))


def locate_part(index: DataFrame, offsets: DataFrame, group: str, order: str, length: str, block: int = 1024) -> DataFrame:
    """Global index -> (part, local index), NULL outside: ranges meet indexes in blocks of ``block``."""
    spans = offsets.filter(F.col(length) > 0).select(F.col(group).alias("_g"), F.col(order).alias("part"), F.col("offset").alias("_a"), (F.col("offset") + F.col(length)).alias("_b"))
    spans = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_b") - 1) / block))))
    inside = (F.col(group) == F.col("_g")) & (F.floor(F.col("idx") / block) == F.col("_k")) & (F.col("idx") >= F.col("_a")) & (F.col("idx") < F.col("_b"))
    return index.join(spans, inside, "left").select(*index.columns, "part", (F.col("idx") - F.col("_a")).alias("local"))


def blend_steps(rows: DataFrame, keys: list[str], step: str, value: str, t: float, steps: int) -> DataFrame:
    """Value between the two neighbours of a position on the timeline; steps are numbered from 0."""
    n = max(2, steps)
    at = min(1.0, max(0.0, t)) * (n - 1)
    low = min(n - 2, int(at))
    side = lambda k: F.max(F.when(F.col(step) == k, F.col(value)))
    both = rows.filter(F.col(step).isin(low, low + 1)).groupBy(*keys).agg(side(low).alias("a"), side(low + 1).alias("b"))
    return both.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (at - low)).alias("value"))


def reconcile_blocks(fine: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled fine cells beside the publisher's coarse table: values and absolute error."""
    both = fine.select(*keys, F.col("value").alias("pooled")).join(published.select(*keys, F.col("value").alias("official")), keys)
    return both.withColumn("error", F.abs(F.col("pooled") - F.col("official")))


def fine_or_coarse(fine: DataFrame, coarse: DataFrame, shown: Column | int | None = None, step: str = "step") -> DataFrame:
    """(cell, value): reading of each fine cell where present, else of the coarse cell beneath it (column ``under`` of ``fine``).

    With ``shown`` both levels follow a timeline: of each cell the newest present value at a step not after the one shown
    counts, found for the fine level and the coarse level in one shuffle, by the coarse cell. Without it rows are taken as they are,
    one for each cell.
    """
    when = F.col(step) if shown is not None else F.lit(0)
    due = F.col("_when") <= shown if shown is not None else F.lit(True)
    rows = fine.select("under", F.col("cell").alias("_cell"), F.lit(True).alias("_fine"), when.alias("_when"), F.col("value").cast("double").alias("_value"))
    rows = rows.unionByName(coarse.select(F.col("cell").alias("under"), F.lit(None).cast(fine.schema["cell"].dataType).alias("_cell"), F.lit(False).alias("_fine"), when.alias("_when"), F.col("value").cast("double").alias("_value")))
    newest = F.max_by("_value", F.when(due & F.col("_value").isNotNull(), F.col("_when")))
    read = rows.repartition("under").groupBy("under", "_cell", "_fine").agg(newest.alias("_value"))
    beneath = F.max(F.when(~F.col("_fine"), F.col("_value"))).over(Window.partitionBy("under"))
    return read.withColumn("_beneath", beneath).filter("_fine").select(F.col("_cell").alias("cell"), F.coalesce("_value", "_beneath").alias("value"))
