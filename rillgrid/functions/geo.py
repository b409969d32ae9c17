"""Cells, distances and map projections as column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 100  # metres


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cell_index(v, size: float = CELL) -> Column:
    """Half-open cell number: a point on an edge belongs to the cell that starts there."""
    return F.floor(_c(v) / F.lit(size)).cast("long")


def cell_id(i, j, size: int = CELL) -> Column:
    """``"x_y"`` of the lower left corner in whole metres."""
    return F.concat_ws("_", (_c(i) * size).cast("string"), (_c(j) * size).cast("string"))


def sequential_id(number) -> Column:
    """Older id form: ``G`` and a running number of at least four digits."""
    return F.format_string("G%04d", _c(number))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_c(x1) - _c(x2), 2) + F.pow(_c(y1) - _c(y2), 2))


def proximity_decay(d, reach: float = 300.0) -> Column:
    """1 at the line, 0 from ``reach`` metres on; unknown distance counts as out of reach."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - _c(d) / F.lit(reach)), F.lit(0.0))


def capped_distance(d, cap: float = 2000.0) -> Column:
    return F.least(_c(d), F.lit(cap)) / F.lit(cap)


@dataclass(frozen=True)
class MapGrid:
    """Transverse Mercator definition on the GRS80 ellipsoid."""

    lat0: float
    lon0: float
    scale: float
    east: float
    north: float


# Published EPSG definitions of the Korean map grids.
GRIDS = {
    5179: MapGrid(38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0),
    5181: MapGrid(38.0, 127.0, 1.0, 200_000.0, 500_000.0),
    5186: MapGrid(38.0, 127.0, 1.0, 200_000.0, 600_000.0),
    5187: MapGrid(38.0, 129.0, 1.0, 200_000.0, 600_000.0),
}
# GRS80 semi-major axis and inverse flattening.
GRS80_A = 6_378_137.0
GRS80_RF = 298.257222101


class Kruger:
    """Coefficients of the published Kruger n-series up to the fourth power."""

    f = 1 / GRS80_RF
    n = f / (2 - f)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    ecc = 2 * math.sqrt(n) / (1 + n)

    @classmethod
    def meridian(cls, lat0: float) -> float:
        """Rectified meridian arc of the origin latitude, in units of the radius."""
        s = math.sin(math.radians(lat0))
        t = math.sinh(math.atanh(s) - cls.ecc * math.atanh(cls.ecc * s))
        xi = math.atan(t)
        return xi + sum(a * math.sin(2 * k * xi) for k, a in enumerate(cls.alpha, 1))


def _total(terms) -> Column:
    out = None
    for t in terms:
        out = t if out is None else out + t
    return out


def _project(df: DataFrame, lon: str, lat: str, epsg: int, x: str, y: str) -> DataFrame:
    """Longitude and latitude in degrees to a grid.

    Shared terms are columns of their own, so they are computed once per row.
    """
    g, K = GRIDS[epsg], Kruger
    size = g.scale * K.radius
    df = df.withColumns({"_s": F.sin(F.radians(lat)), "_l": F.radians(F.col(lon) - F.lit(g.lon0))})
    df = df.withColumn("_t", F.sinh(F.atanh("_s") - F.lit(K.ecc) * F.atanh(F.lit(K.ecc) * F.col("_s"))))
    df = df.withColumns(
        {"_xi": F.atan(F.col("_t") / F.cos("_l")), "_eta": F.atanh(F.sin("_l") / F.sqrt(1 + F.col("_t") * F.col("_t")))}
    )
    xi, eta = F.col("_xi"), F.col("_eta")
    north = xi + _total(F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(K.alpha, 1))
    east = eta + _total(F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(K.alpha, 1))
    return df.withColumns(
        {x: F.lit(g.east) + F.lit(size) * east, y: F.lit(g.north) + F.lit(size) * (north - F.lit(K.meridian(g.lat0)))}
    ).drop("_s", "_l", "_t", "_xi", "_eta")


def _unproject(df: DataFrame, x: str, y: str, epsg: int, lon: str, lat: str) -> DataFrame:
    """Grid coordinates to longitude and latitude in degrees."""
    g, K = GRIDS[epsg], Kruger
    size = g.scale * K.radius
    df = df.withColumns(
        {"_n": (F.col(y) - F.lit(g.north)) / F.lit(size) + F.lit(K.meridian(g.lat0)), "_e": (F.col(x) - F.lit(g.east)) / F.lit(size)}
    )
    n, e = F.col("_n"), F.col("_e")
    df = df.withColumns(
        {
            "_xi": n - _total(F.lit(b) * F.sin(2 * k * n) * F.cosh(2 * k * e) for k, b in enumerate(K.beta, 1)),
            "_eta": e - _total(F.lit(b) * F.cos(2 * k * n) * F.sinh(2 * k * e) for k, b in enumerate(K.beta, 1)),
        }
    )
    df = df.withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    chi = F.col("_chi")
    north = chi + _total(F.lit(d) * F.sin(2 * k * chi) for k, d in enumerate(K.delta, 1))
    return df.withColumns(
        {lon: F.lit(g.lon0) + F.degrees(F.atan(F.sinh("_eta") / F.cos("_xi"))), lat: F.degrees(north)}
    ).drop("_n", "_e", "_xi", "_eta", "_chi")


def reproject(df: DataFrame, x: str, y: str, source: int, target: int, out_x: str = "x", out_y: str = "y") -> DataFrame:
    """Between grids and 4326, where x is longitude and y latitude."""
    if source == target:
        return df.withColumns({out_x: F.col(x), out_y: F.col(y)})
    if source == 4326:
        return _project(df, x, y, target, out_x, out_y)
    if target == 4326:
        return _unproject(df, x, y, source, out_x, out_y)
    return _project(_unproject(df, x, y, source, "_lon", "_lat"), "_lon", "_lat", target, out_x, out_y).drop("_lon", "_lat")
