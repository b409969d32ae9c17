"""Exports.  Parquet is the working format; these are for people and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.functions.geo import CELL


def save_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_top_table(top: DataFrame, path: str, most: int = 1000) -> str:
    """One CSV file; only for short lists, longer ones are refused."""
    if top.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows belong in save_csv")
    top.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def grid_features(grid: DataFrame, size: int = CELL) -> DataFrame:
    """One GeoJSON Feature text per cell; ``i, j`` give the square, the rest become properties."""
    x0, y0 = F.col("i") * size, F.col("j") * size
    corner = lambda dx, dy: F.array((x0 + dx).cast("double"), (y0 + dy).cast("double"))
    ring = F.array(corner(0, 0), corner(size, 0), corner(size, size), corner(0, size), corner(0, 0))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(*[F.col(c) for c in grid.columns if c not in ("i", "j")])
    return grid.select(
        F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value")
    )


def save_grid_geojson(grid: DataFrame, path: str, size: int = CELL) -> str:
    """Line-delimited features, written in parallel."""
    grid_features(grid, size).write.mode("overwrite").text(path)
    return path
