"""Rasters as pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Area of one forest pixel, 30 m x 30 m.
PIXEL_KM2 = 0.0009


def block_reduce(pixels: DataFrame, block: int, flags: dict[str, Column], need: str) -> DataFrame:
    """Sums of flags over block x block pixels with the block's centre; incomplete blocks and those without ``need`` go."""
    at = [F.floor(F.col(c) / block).cast("long").alias(f"b{c}") for c in ("r", "c")]
    sums = pixels.groupBy(*at).agg(F.count("*").alias("_n"), *[F.sum(f.cast("long")).alias(n) for n, f in flags.items()])
    centre = lambda c: (F.col(f"b{c}") * block + block / 2).alias(f"{c}_centre")
    return sums.filter((F.col("_n") == block * block) & (F.col(need) > 0)).select("br", "bc", centre("r"), centre("c"), *flags)


def forest_metrics(counts: DataFrame, agents: list[str], area_km2: float) -> DataFrame:
    """Adds forest_share, disturbed_share, agent and dominance to pixel counts; no forest, no metric; no disturbance, no cause."""
    forest, disturbed = F.col("forest"), F.col("disturbed")
    pairs = F.array(*[F.struct(F.col(a).alias("n"), F.lit(-i).alias("i")) for i, a in enumerate(agents)])
    top, known = F.array_max(pairs), sum((F.col(a) for a in agents[1:]), F.col(agents[0]))
    caused = (forest > 0) & (disturbed > 0) & (known > 0)
    return counts.withColumns({
        "forest_share": F.when(forest > 0, F.least(F.lit(1.0), forest * PIXEL_KM2 / area_km2)),
        "disturbed_share": F.when(forest > 0, F.least(F.lit(1.0), disturbed / forest)),
        "agent": F.when(caused, -top["i"]),
        "dominance": F.when(caused, top["n"] / known),
    })


def check_same_grid(layers: DataFrame) -> DataFrame:
    """(layer, height, width, same): layers whose size differs from the most common one are named as not the same."""
    sizes = layers.groupBy("layer").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    most = sizes.groupBy("height", "width").agg(F.count("*").alias("n")).agg(F.max_by(F.struct("height", "width"), F.struct("n", "height", "width")).alias("m"))
    return sizes.join(F.broadcast(most)).select("layer", "height", "width", ((F.col("height") == F.col("m.height")) & (F.col("width") == F.col("m.width"))).alias("same"))


def latest_granule(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Per key the lexicographically last file."""
    return files.groupBy(*keys).agg(F.max(name).alias(name))
