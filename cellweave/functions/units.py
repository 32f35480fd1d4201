"""Registered units: when they stand, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status codes of the register.
RUNNING, PAUSED, SHUT, OFFSHORE = 35, 37, 38, 889


def installed_in_year(year: Column, status: Column, commissioned: Column, decommissioned: Column) -> Column:
    """Running, paused or shut; commissioned by the year; a shut unit needs a date of shutdown after it."""
    gone = (status == SHUT) & decommissioned.isNull() | F.coalesce(F.year(decommissioned) <= year, F.lit(False))
    return F.coalesce(status.isin(RUNNING, PAUSED, SHUT) & (F.year(commissioned) <= year) & ~gone, F.lit(False))


def onshore(lage: Column) -> Column:
    return F.coalesce(lage != OFFSHORE, F.lit(True))


def usable_units(units: DataFrame) -> DataFrame:
    """Those with place and power, inside the globe and not at (0, 0)."""
    lon, lat = F.col("lon"), F.col("lat")
    good = lon.between(-180, 180) & lat.between(-90, 90) & ((lon != 0) | (lat != 0))
    return units.filter(lon.isNotNull() & lat.isNotNull() & F.col("kw").isNotNull() & good)


def expand_years(units: DataFrame, first: int, last: int) -> DataFrame:
    """Each unit once for every year in which it stands, from its own range of years."""
    start = F.greatest(F.lit(first), F.year("commissioned"))
    end = F.least(F.lit(last), F.coalesce(F.year("decommissioned") - 1, F.lit(last)))
    stands = F.col("status").isin(RUNNING, PAUSED, SHUT) & ~((F.col("status") == SHUT) & F.col("decommissioned").isNull()) & (start <= end)
    return units.withColumn("year", F.explode(F.when(stands, F.sequence(start, end))))
