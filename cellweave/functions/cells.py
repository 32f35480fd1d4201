"""A hexagonal lattice on the equal-area plane, as column arithmetic.

A cell is a pair of axial coordinates at a resolution, packed in one bigint.
The parent is the cell one resolution up that holds the child's centre,
applied step by step, so going up two levels equals going up one twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge length in metres by resolution, and the resolution that groups cells in tiles.
EDGE_METRES = {5: 8544.4, 6: 3229.5, 7: 1220.6, 8: 461.4, 9: 174.4, 10: 65.9}
TILE_RES = 5
SHIFT, BIAS = 26, 1 << 25
#: Steps up that one generated method holds beside other work.
NATIVE_STEPS = 2
ROOT3 = math.sqrt(3.0)


def with_cell(rows: DataFrame, x: str, y: str, res: int, name: str = "cell") -> DataFrame:
    """Adds the cell that holds a point in metres: round axial coordinates, mend the one with the largest error.

    Each step is a projection of its own, so no expression is repeated. The
    last one adds a zero that depends on the partition, which the optimizer
    takes for no constant: else it would push filters on the cell below all
    steps and repeat every expression in them.
    """
    a, keep = EDGE_METRES[res], [c for c in rows.columns if c != name]
    q, r, s = (F.col(c) for c in ("_q", "_r", "_s"))
    rows = rows.withColumns({"_q": (F.col(x) * (ROOT3 / 3) - F.col(y) / 3) / a, "_r": (F.col(y) * 2 / 3) / a})
    rows = rows.withColumn("_s", -q - r)
    rows = rows.withColumns({"_rq": F.floor(q + 0.5), "_rr": F.floor(r + 0.5), "_rs": F.floor(s + 0.5)})
    rows = rows.withColumns({"_dq": F.abs(F.col("_rq") - q), "_dr": F.abs(F.col("_rr") - r), "_ds": F.abs(F.col("_rs") - s)})
    mend_q = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    cq = F.when(mend_q, -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    cr = F.when(~mend_q & (F.col("_dr") > F.col("_ds")), -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    return rows.select(*keep, (pack(res, cq, cr) + F.spark_partition_id() * 0).alias(name))


def pack(res: int, q: Column, r: Column) -> Column:
    top = F.lit(res << SHIFT).cast("long")
    return (top + q + BIAS) * (1 << SHIFT) + r + BIAS


def axial(cell: Column) -> tuple[Column, Column]:
    mask = F.lit((1 << SHIFT) - 1).cast("long")
    return F.shiftright(cell, SHIFT).bitwiseAND(mask) - BIAS, cell.bitwiseAND(mask) - BIAS


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 2 * SHIFT).cast("int")


def centre(cell: Column, res: int) -> tuple[Column, Column]:
    """(x, y) in metres."""
    q, r = axial(cell)
    a = EDGE_METRES[res]
    return (q + r / 2) * (a * ROOT3), r * (a * 1.5)


def with_parent(rows: DataFrame, cell: str, res: int, to: int, name: str = "parent") -> DataFrame:
    """Adds the ancestor at resolution ``to`` of a cell of resolution ``res``.

    One step makes some 2,000 bytes of generated code, and the JVM compiles no method of over 8,000, so more than
    ``NATIVE_STEPS`` steps are taken by numpy, with the same arithmetic.
    """
    if res - to > NATIVE_STEPS:
        return rows.withColumn(name, ancestor(res, to)(F.col(cell)))
    rows = rows.withColumn(name, F.col(cell))
    for r in range(res - 1, to - 1, -1):
        x, y = centre(F.col(name), r + 1)
        rows = with_cell(rows.withColumns({"_x": x, "_y": y}), "_x", "_y", r, name).drop("_x", "_y")
    return rows


def ancestor(res: int, to: int) -> Callable[[Column], Column]:
    """The ancestor at resolution ``to`` of cells of resolution ``res``, as a vectorized function; that of a null is null."""

    @F.arrow_udf("long")
    def up(cell: pa.Array) -> pa.Array:
        mask, now = (1 << SHIFT) - 1, cell.fill_null(0).to_numpy(zero_copy_only=False)
        for r in range(res - 1, to - 1, -1):
            a, b = EDGE_METRES[r + 1], EDGE_METRES[r]
            q, s = ((now >> SHIFT) & mask) - BIAS, (now & mask) - BIAS
            x, y = (q + s / 2) * (a * ROOT3), s * (a * 1.5)
            fq, fr = (x * (ROOT3 / 3) - y / 3) / b, (y * 2 / 3) / b
            fs = -fq - fr
            rq, rr, rs = np.floor(fq + 0.5), np.floor(fr + 0.5), np.floor(fs + 0.5)
            dq, dr, ds = np.abs(rq - fq), np.abs(rr - fr), np.abs(rs - fs)
            mend_q = (dq > dr) & (dq > ds)
            cq = np.where(mend_q, -rr - rs, rq).astype(np.int64)
            cr = np.where(~mend_q & (dr > ds), -rq - rs, rr).astype(np.int64)
            now = (((r << SHIFT) + cq + BIAS) << SHIFT) + cr + BIAS
        return pa.array(now, pa.int64(), mask=cell.is_null().to_numpy(zero_copy_only=False))

    return up


def area_km2(res: int) -> float:
    """The same for every cell of a level."""
    return 1.5 * ROOT3 * EDGE_METRES[res] ** 2 / 1e6


def square_of(x: Column, y: Column, side: int) -> Column:
    """Square block id: the exactly nested second index."""
    return F.floor(y / side) * (1 << SHIFT) + F.floor(x / side)
