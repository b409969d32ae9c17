"""Inverse-distance interpolation from stations to cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.operators.spatial import k_nearest
from rillgrid.staging import settle

NEAREST = 12
RADIUS = 10_000.0


def _weighted(power):
    w = 1 / F.pow(F.greatest("d", F.lit(1e-6)), power)
    return F.sum(w * F.col("value")) / F.sum(w)


def idw(stations: DataFrame, cells: DataFrame, station_key: str, cell_key: str, value: str, power: float = 2.0,
        k: int = NEAREST, radius: float = RADIUS) -> DataFrame:
    """``(cell, value, extrapolated)``: weighted mean of the ``k`` nearest stations within ``radius``;
    cells without one take the nearest value and are flagged."""
    known = stations.where(F.col(value).isNotNull())
    values = known.select(F.col(station_key), F.col(value).cast("double").alias("value"))
    near = k_nearest(cells, known, cell_key, station_key, k, radius)
    near = settle(near, "idw")
    inside = near.join(values, station_key).groupBy(cell_key).agg(_weighted(F.lit(float(power))).alias("value"))
    inside = inside.withColumn("extrapolated", F.lit(False))
    lonely = cells.join(near, cell_key, "left_anti")
    if lonely.isEmpty():
        return inside
    far = k_nearest(lonely, known, cell_key, station_key, 1)
    outside = far.join(values, station_key).select(cell_key, "value", F.lit(True).alias("extrapolated"))
    return inside.unionByName(outside)


def idw_leave_one_out(stations: DataFrame, station_key: str, value: str, powers: Sequence[float] = (1, 2, 3),
                      k: int = NEAREST, radius: float = RADIUS) -> DataFrame:
    """``(power, rmse, n)`` from predicting each station by its ``k`` nearest others.

    Neighbours are found once and serve every power.
    """
    known = stations.where(F.col(value).isNotNull()).select(station_key, "x", "y", F.col(value).cast("double").alias("value"))
    near = k_nearest(known, known.withColumnRenamed(station_key, "_other"), station_key, "_other", k, radius, exclude_self=True)
    values = known.select(F.col(station_key).alias("_other"), "value")
    fits = near.join(values, "_other").groupBy(station_key).agg(*[_weighted(F.lit(float(p))).alias(f"p{n}") for n, p in enumerate(powers)])
    errors = fits.join(known.select(station_key, "value"), station_key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sqrt(F.avg(F.pow(F.col(f"p{n}") - F.col("value"), 2))).alias(f"p{n}") for n, _ in enumerate(powers)],
    )
    rows = F.array(*[F.struct(F.lit(float(p)).alias("power"), F.col(f"p{n}").alias("rmse"), F.col("n")) for n, p in enumerate(powers)])
    return errors.select(F.explode(rows).alias("r")).select("r.*")


def best_power(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min_by("power", F.round("rmse", 9)).alias("power"), F.min("rmse").alias("rmse"))
