"""Heights and colours of a map: calibration by stored statistics, scales and mixing.

``stats`` arguments are struct columns with min, max, p50, p95, p995.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour of missing cells, of the paper, and how far cells outside a region step back.
MISSING, PAPER = (214, 208, 200), (247, 240, 234)
FOCUS_HEIGHT, FOCUS_PAPER_MIX = 0.28, 0.72
DOMINANCE_LOW, DOMINANCE_SPAN = 0.33, 0.57
TARGET_METRES, PEAKEDNESS = 100_000.0, 0.55


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("int")


def quantile_from_stats(stats: Column, q: Column) -> Column:
    return F.when(q <= 0.5, stats["p50"]).when(q <= 0.95, stats["p95"]).when(q <= 0.995, stats["p995"]).otherwise(stats["max"])


def height_scale(stats: Column, target: float = TARGET_METRES, q: float = 0.995, peakedness: float = PEAKEDNESS, zero: float = 0.0) -> Column:
    """Metres per unit: the anchor quantile, drawn towards the maximum by ``peakedness``, reaches the target."""
    p = min(1.0, max(0.0, peakedness))
    anchor = quantile_from_stats(stats, F.lit(q)) - zero
    top = F.when(stats["max"] - zero > 0, stats["max"] - zero).otherwise(anchor)
    return F.when(anchor > 0, target / (anchor * F.pow(top / anchor, F.lit(p)))).otherwise(1.0)


def fine_height_scale(scale: Column, is_count: Column, coarse_edge: Column, fine_edge: Column) -> Column:
    """A count is redrawn per area; other values carry over."""
    return F.when(is_count & (coarse_edge > 0) & (fine_edge > 0), scale * F.pow(coarse_edge / fine_edge, 2)).otherwise(scale)


def elevation(value: Column, scale: Column, zero: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce((value - zero) * scale, F.lit(0.0)))


def sequential_domain(stats: Column, clip: float | None = None) -> tuple[Column, Column]:
    high = stats["max"] if clip is None else F.when(F.lit(clip) <= 0.5, stats["p50"]).when(F.lit(clip) <= 0.95, stats["p95"]).otherwise(stats["p995"])
    low = F.when(stats["min"] >= 0, F.lit(0.0)).otherwise(stats["min"])
    return low, F.when(high <= low, low + 1).otherwise(high)


def transformed(kind: str, v: Column) -> Column:
    if kind == "linear":
        return v
    positive = F.greatest(F.lit(0.0), v)
    return F.sqrt(positive) if kind == "sqrt" else F.log1p(positive)


def interpolate(stops: list[tuple[int, int, int]], t: Column) -> Column:
    """array(r, g, b) on the way between palette stops, t clamped to [0, 1]."""
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (len(stops) - 1)
    i = F.least(F.lit(max(0, len(stops) - 2)), F.floor(at)).cast("int")

    def channel(k: int) -> Column:
        table = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.get(table, i), F.coalesce(F.get(table, i + 1), F.get(table, i))
        return js_round(a + (b - a) * (at - i))

    return F.array(*[channel(k) for k in range(3)])


def fixed(rgb: tuple[int, int, int]) -> Column:
    return F.array(*[F.lit(c) for c in rgb])


def color_sequential(v: Column, low: Column, high: Column, stops: list[tuple[int, int, int]], kind: str = "linear", gamma: float = 1.0) -> Column:
    a, b = transformed(kind, low), transformed(kind, high)
    span = F.when(b - a == 0, F.lit(1.0)).otherwise(b - a)
    t = (transformed(kind, v) - a) / span
    if gamma != 1:
        t = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), F.lit(gamma))
    return F.when(v.isNull(), fixed(MISSING)).otherwise(interpolate(stops, t))


def color_diverging(v: Column, stats: Column, stops: list[tuple[int, int, int]], center: float = 0.0, half_width: float | None = None) -> Column:
    wide = F.greatest(F.abs(stats["min"] - center), F.abs(stats["max"] - center)) if half_width is None else F.lit(half_width)
    wide = F.when(wide == 0, F.lit(1.0)).otherwise(wide)
    return F.when(v.isNull(), fixed(MISSING)).otherwise(interpolate(stops, 0.5 + (v - center) / (wide * 2)))


def color_categorical(category: Column, colors: list[tuple[int, int, int]], neutral: tuple[int, int, int], dominance: Column | None = None) -> Column:
    """Palette colour, missing colour if unknown, mixed with the neutral where no category dominates."""
    s = F.lit(1.0) if dominance is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (dominance - DOMINANCE_LOW) / DOMINANCE_SPAN)) * 0.75 + 0.25

    def channel(k: int) -> Column:
        own = F.coalesce(F.get(F.array(*[F.lit(c[k]) for c in colors]), category.cast("int")), F.lit(MISSING[k]))
        return js_round((own - neutral[k]) * s + neutral[k])

    return F.array(*[channel(k) for k in range(3)])


def apply_shade(color: Column, shade: Column, strength: float) -> Column:
    """Darkened by the share of taller neighbours; stores cut off what is behind the point."""
    return color if strength == 0 else F.transform(color, lambda c: F.floor(c * (1 - shade * strength)).cast("int"))


def region_dim(height: Column, color: Column, inside: Column) -> tuple[Column, Column]:
    """Outside a region: lower, and most of the way to the paper's colour."""
    mixed = F.array(*[F.floor(F.get(color, k) + (F.lit(PAPER[k]) - F.get(color, k)) * FOCUS_PAPER_MIX).cast("int") for k in range(3)])
    return F.when(inside, height).otherwise(height * FOCUS_HEIGHT), F.when(inside, color).otherwise(mixed)


def time_segment(t: Column, steps: int) -> tuple[Column, Column]:
    """Position on a timeline -> lower step and the part of the way to the next."""
    n = max(2, steps)
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (n - 1)
    i = F.least(F.lit(n - 2), F.floor(at)).cast("int")
    return i, at - i


def blend(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def encode_f32(v: Column) -> Column:
    """Missing -> NaN, only for the sink."""
    return F.coalesce(v.cast("float"), F.lit(float("nan")).cast("float"))


def encode_u8(v: Column) -> Column:
    return F.coalesce(v.cast("int"), F.lit(255))
