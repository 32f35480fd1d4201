"""Pooling of values per cell. Every rule carries two sums (num, den) and divides once, at the end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import cells

RULES = ("sum", "wmean", "hmean", "share", "mean")


@dataclass(frozen=True)
class MetricSpec:
    """How one metric is pooled: the columns that it reads and what absent cells become."""

    rule: str
    value: str | None = None
    weight: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    min_denominator: float = 0.0
    fill: str = "null"
    categories: tuple[str, ...] = field(default=())


def partials(spec: MetricSpec) -> tuple[Column, Column]:
    """What one row adds to (num, den); NULL where it adds nothing."""
    if spec.rule == "share":
        n, d = F.col(spec.numerator), F.col(spec.denominator)
        both = n.isNotNull() & d.isNotNull()
        return F.when(both, n), F.when(both, d)
    v = F.col(spec.value)
    if spec.rule in ("sum", "mean"):
        return v, F.when(v.isNotNull(), F.lit(1.0))
    w = F.col(spec.weight)
    if spec.rule == "wmean":
        use = v.isNotNull() & (w > 0)
        return F.when(use, v * w), F.when(use, w)
    if spec.rule == "hmean":
        use = (v > 0) & (w > 0)
        return F.when(use, w), F.when(use, w / v)
    raise ValueError(f"no rule {spec.rule}")


def pool(rows: DataFrame, spec: MetricSpec, keys: list[str]) -> DataFrame:
    """keys, num, den. A group without a row that counts does not exist."""
    num, den = partials(spec)
    return rows.groupBy(*keys).agg(F.sum(num).alias("num"), F.sum(den).alias("den")).filter("den is not null")


def finish(spec: MetricSpec, num: Column | None = None, den: Column | None = None) -> Column:
    """The value of two sums, columns num and den if none are given. The least denominator of a share holds at every level."""
    num, den = (F.col(name) if c is None else c for name, c in (("num", num), ("den", den)))
    if spec.rule == "sum":
        return F.when(den > 0, num)
    enough = (den > 0) & (den >= spec.min_denominator) if spec.rule == "share" else den > 0
    return F.when(enough, num / den)


def levels(base: DataFrame, res: int, up: list[int], cell: str = "cell") -> DataFrame:
    """Each row of the base level once for itself and once for each coarser level: res and cell are replaced. A level goes up from the one below it."""
    names, now, below, at = [f"_up{r}" for r in up], base, cell, res
    for r, name in sorted(zip(up, names, strict=True), reverse=True):
        now = cells.with_parent(now, below, at, r, name)
        below, at = name, r
    own = [F.struct(F.lit(r).alias("res"), F.col(c).alias("cell")) for r, c in zip([res, *up], [cell, *names], strict=True)]
    now = now.withColumn("_at", F.explode(F.array(*own)))
    return now.withColumn("res", F.col("_at.res")).withColumn("cell", F.col("_at.cell")).drop("_at", *names)


def rollup(base: DataFrame, res: int, up: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, res, cell, num, den): every level pooled from the base level in one shuffle."""
    return levels(base, res, up).groupBy(*keys, "res", "cell").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def pool_categories(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, category, n: positive counts by the position of their column."""
    pairs = F.array(*[F.struct(F.lit(i).alias("category"), F.col(c).alias("n")) for i, c in enumerate(columns)])
    long = rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.category", "p.n").filter("n > 0")
    return long.groupBy(*keys, "category").agg(F.sum("n").alias("n"))


def dominant(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, category (largest count, lowest index on ties), dominance, total."""
    best = F.max_by("category", F.struct(F.col("n"), -F.col("category"))).alias("category")
    top = counts.filter("n > 0").groupBy(*keys).agg(best, F.max("n").alias("_top"), F.sum("n").alias("total"))
    return top.select(*keys, "category", (F.col("_top") / F.col("total")).alias("dominance"), "total")


def pool_counts(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def class_shares(counts: DataFrame, artificial: list[int], keys: list[str]) -> DataFrame:
    """(keys, category, n) -> artificial_share, dominant, dominance; NULL without a count."""
    best = F.max_by("category", F.when(F.col("n") > 0, F.struct(F.col("n"), -F.col("category"))))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("category").isin(artificial), F.col("n")).otherwise(0)).alias("_a"), F.max("n").alias("_m"), best.alias("_b"))
    some = F.col("_n") > 0
    return out.select(*keys, F.when(some, F.col("_a") / F.col("_n")).alias("artificial_share"), F.when(some, F.col("_b")).alias("dominant"), F.when(some, F.col("_m") / F.col("_n")).alias("dominance"))


def scale_to_total(rows: DataFrame, weight: str, target: float, name: str = "scaled") -> DataFrame:
    """Weights scaled so that they add up to ``target``: the sum comes from one aggregation, not from one window task."""
    total = F.broadcast(rows.agg(F.sum(weight).alias("_total")))  # one row
    return rows.join(total).withColumn(name, F.col(weight) * target / F.col("_total")).drop("_total")
