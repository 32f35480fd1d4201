"""Map projections in closed form, one projection step at a time so that no expression is repeated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ellipsoids (semi-major axis, flattening), projection parameters, and the datum shift
# (metres, arc-seconds, parts per million) from the Bessel datum to WGS84.
GRS80, BESSEL = (6378137.0, 1 / 298.257222101), (6377397.155, 1 / 299.1528128)
LAEA = {"lon0": 10.0, "lat0": 52.0, "x0": 4321000.0, "y0": 3210000.0}
UTM32 = {"ellipsoid": GRS80, "lon0": 9.0, "k0": 0.9996, "x0": 500000.0}
GK3 = {"ellipsoid": BESSEL, "lon0": 9.0, "k0": 1.0, "x0": 3500000.0}
BESSEL_SHIFT = {"t": (598.1, 73.7, 418.2), "r": (0.202, 0.045, -2.455), "s": 6.7}


def _authalic(f: float) -> tuple[float, float, list[float]]:
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    qp = 1 + (1 - e2) / (2 * e) * math.log((1 + e) / (1 - e))
    return e, qp, [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]


def _q(e: float, sin: float) -> float:
    return (1 - e * e) * (sin / (1 - e * e * sin * sin) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))


def _laea() -> dict[str, float]:
    a, f = GRS80
    e, qp, _ = _authalic(f)
    phi = math.radians(LAEA["lat0"])
    beta = math.asin(_q(e, math.sin(phi)) / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2) / (rq * math.cos(beta))
    return {"e": e, "qp": qp, "sin": math.sin(beta), "cos": math.cos(beta), "rq": rq, "d": d}


def to_laea(rows: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Degrees -> metres of the European equal-area plane."""
    k, keep = _laea(), [c for c in rows.columns if c not in (x, y)]
    e = k["e"]
    rows = rows.withColumns({"_s": F.sin(F.radians(lat)), "_l": F.radians(F.col(lon) - LAEA["lon0"])})
    s = F.col("_s")
    q = (s / (1 - s * s * (e * e)) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e * e)
    rows = rows.withColumn("_sb", q / k["qp"]).withColumn("_cb", F.sqrt(1 - F.col("_sb") * F.col("_sb")))
    sb, cb, cl = F.col("_sb"), F.col("_cb"), F.cos("_l")
    rows = rows.withColumn("_b", F.sqrt(F.lit(2.0) / (1 + sb * k["sin"] + cb * cl * k["cos"])) * k["rq"])
    b = F.col("_b")
    return rows.select(*keep, (LAEA["x0"] + b * k["d"] * cb * F.sin("_l")).alias(x), (LAEA["y0"] + b / k["d"] * (sb * k["cos"] - cb * cl * k["sin"])).alias(y))


def from_laea(rows: DataFrame, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Metres of the European equal-area plane -> degrees."""
    k, (_, _, series) = _laea(), _authalic(GRS80[1])
    keep = [c for c in rows.columns if c not in (lon, lat)]
    rows = rows.withColumns({"_u": (F.col(x) - LAEA["x0"]) / k["d"], "_v": (F.col(y) - LAEA["y0"]) * k["d"]})
    rows = rows.withColumn("_p", F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")))
    rows = rows.withColumn("_c", F.asin(F.col("_p") / (2 * k["rq"])) * 2)
    sc, cc, p, v = F.sin("_c"), F.cos("_c"), F.col("_p"), F.col("_v")
    beta = F.asin(cc * k["sin"] + F.when(p > 0, v * sc * k["cos"] / p).otherwise(0.0))
    rows = rows.withColumns({"_b": beta, "_l": F.when(p > 0, F.atan2(F.col("_u") * sc, p * k["cos"] * cc - v * k["sin"] * sc)).otherwise(0.0)})
    b = F.col("_b")
    phi = b + F.sin(b * 2) * series[0] + F.sin(b * 4) * series[1] + F.sin(b * 6) * series[2]
    return rows.select(*keep, (F.degrees("_l") + LAEA["lon0"]).alias(lon), F.degrees(phi).alias(lat))


def _kruger(f: float) -> tuple[float, list[float], list[float], list[float]]:
    n = f / (2 - f)
    scale = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    up = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    down = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    lat = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return scale, up, down, lat


def to_tm(rows: DataFrame, zone: dict, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Degrees -> metres of a transverse Mercator zone, by a series of third order."""
    a, f = zone["ellipsoid"]
    scale, up, _, _ = _kruger(f)
    e, keep = math.sqrt(f * (2 - f)), [c for c in rows.columns if c not in (x, y)]
    rows = rows.withColumns({"_s": F.sin(F.radians(lat)), "_l": F.radians(F.col(lon) - zone["lon0"])})
    rows = rows.withColumn("_t", F.sinh(F.atanh("_s") - F.atanh(F.col("_s") * e) * e))
    rows = rows.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_l")), "_eta": F.atanh(F.sin("_l") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    xi, eta = F.col("_xi"), F.col("_eta")
    east = eta + sum((F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c for j, c in enumerate(up[1:], 2)), F.cos(xi * 2) * F.sinh(eta * 2) * up[0])
    north = xi + sum((F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c for j, c in enumerate(up[1:], 2)), F.sin(xi * 2) * F.cosh(eta * 2) * up[0])
    k = zone["k0"] * a * scale
    return rows.select(*keep, (zone["x0"] + east * k).alias(x), (north * k).alias(y))


def from_tm(rows: DataFrame, zone: dict, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Metres of a transverse Mercator zone -> degrees on its own ellipsoid."""
    a, f = zone["ellipsoid"]
    scale, _, down, series = _kruger(f)
    k, keep = zone["k0"] * a * scale, [c for c in rows.columns if c not in (lon, lat)]
    rows = rows.withColumns({"_x": F.col(y) / k, "_e": (F.col(x) - zone["x0"]) / k})
    xi, eta = F.col("_x"), F.col("_e")
    xi1 = xi - sum((F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c for j, c in enumerate(down[1:], 2)), F.sin(xi * 2) * F.cosh(eta * 2) * down[0])
    eta1 = eta - sum((F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c for j, c in enumerate(down[1:], 2)), F.cos(xi * 2) * F.sinh(eta * 2) * down[0])
    rows = rows.withColumns({"_xi": xi1, "_eta": eta1}).withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    chi = F.col("_chi")
    phi = chi + sum((F.sin(chi * (2 * j)) * c for j, c in enumerate(series[1:], 2)), F.sin(chi * 2) * series[0])
    return rows.select(*keep, (F.degrees(F.atan2(F.sinh("_eta"), F.cos("_xi"))) + zone["lon0"]).alias(lon), F.degrees(phi).alias(lat))


def bessel_to_wgs84(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Seven-parameter shift through geocentric coordinates; good to a few metres."""
    (a, f), (b, g), shift = BESSEL, GRS80, BESSEL_SHIFT
    e2, keep = f * (2 - f), [c for c in rows.columns if c not in (lon, lat)]
    rx, ry, rz = (math.radians(v / 3600) for v in shift["r"])
    m, (tx, ty, tz) = 1 + shift["s"] * 1e-6, shift["t"]
    rows = rows.withColumns({"_p": F.radians(lat), "_l": F.radians(lon)})
    rows = rows.withColumn("_n", F.lit(a) / F.sqrt(1 - F.pow(F.sin("_p"), 2) * e2))
    n = F.col("_n")
    rows = rows.withColumns({"_x": n * F.cos("_p") * F.cos("_l"), "_y": n * F.cos("_p") * F.sin("_l"), "_z": n * (1 - e2) * F.sin("_p")})
    x, y, z = (F.col(c) for c in ("_x", "_y", "_z"))
    rows = rows.withColumns({"_u": (x - y * rz + z * ry) * m + tx, "_v": (x * rz + y - z * rx) * m + ty, "_w": (y * rx - x * ry + z) * m + tz})
    e2, minor = g * (2 - g), b * (1 - g)
    rows = rows.withColumn("_h", F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")))
    rows = rows.withColumn("_t", F.atan2(F.col("_w") * b, F.col("_h") * minor))
    ep2 = e2 / (1 - e2)
    phi = F.atan2(F.col("_w") + F.pow(F.sin("_t"), 3) * (ep2 * minor), F.col("_h") - F.pow(F.cos("_t"), 3) * (e2 * b))
    return rows.select(*keep, F.degrees(F.atan2("_v", "_u")).alias(lon), F.degrees(phi).alias(lat))


def gk3_to_wgs84(rows: DataFrame, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    return bessel_to_wgs84(from_tm(rows, GK3, x, y, lon, lat), lon, lat)
