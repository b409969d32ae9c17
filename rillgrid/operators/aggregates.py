"""Per-cell and per-district aggregates, profiles and correlation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.functions.geo import CELL
from rillgrid.functions.scores import is_old
from rillgrid.operators.ordering import moments, quantiles

CELL_KM2 = CELL * CELL / 1e6


def pipe_features(pipes: DataFrame, keys: Sequence[str] = ("i", "j"), combined: str | None = None,
                  materials: Sequence[str] = (), area_km2: float = CELL_KM2) -> DataFrame:
    """Age, diameter, material and density of the pipes of each cell.

    ``pipes`` has ``age, length, diameter, material``; ``combined`` names a boolean column.
    """
    old = is_old("age")
    share = lambda flag: F.try_divide(F.sum(F.when(flag, F.col("length")).otherwise(0.0)), F.sum("length"))
    aggs = [
        F.avg(old.cast("double")).alias("old_pipe_ratio"),
        F.sum("length").alias("pipe_length"),
        share(old).alias("old_length_share"),
        F.avg("age").alias("mean_age"),
        F.max("age").alias("max_age"),
        F.avg("diameter").alias("mean_diameter"),
        F.min("diameter").alias("min_diameter"),
        (F.sum("length") / 1000 / F.lit(area_km2)).alias("pipe_density"),
    ]
    aggs += [share(F.col("material") == m).alias(f"share_{m}") for m in materials]
    if combined:
        aggs.append(share(F.col(combined)).alias("combined_share"))
    return pipes.groupBy(*keys).agg(*aggs)


def old_building_ratio(buildings: DataFrame, keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """Share of buildings aged 30 or more; unknown age counts as not old."""
    return buildings.groupBy(*keys).agg(F.avg(F.when(is_old("age"), 1.0).otherwise(0.0)).alias("old_building_ratio"))


def sum_per_cell(points: DataFrame, value: str, alias: str, keys: Sequence[str] = ("i", "j")) -> DataFrame:
    return points.groupBy(*keys).agg(F.sum(value).alias(alias))


def count_per_cell(points: DataFrame, flags: Mapping[str, F.Column] | None = None, keys: Sequence[str] = ("i", "j"),
                   alias: str = "n") -> DataFrame:
    """Row count and one conditional count per flag."""
    aggs = [F.count(F.lit(1)).alias(alias)]
    aggs += [F.sum(F.when(flag, 1).otherwise(0)).alias(name) for name, flag in (flags or {}).items()]
    return points.groupBy(*keys).agg(*aggs)


def area_weighted_mean(parts: DataFrame, keys: Sequence[str], value: str, area: str, alias: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(area)).alias(alias))


def land_cover_share(parts: DataFrame, code: str, urban_prefix: str = "1", water: str = "710", cell_area: float = CELL * CELL) -> DataFrame:
    """Built-up share of the cell area and presence of inland water."""
    return parts.groupBy("i", "j").agg(
        (F.sum(F.when(F.col(code).startswith(urban_prefix), F.col("area")).otherwise(0.0)) / F.lit(float(cell_area))).alias("impervious"),
        F.max((F.col(code) == water).cast("int")).alias("inland_water"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), F.col(column)).limit(top)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins; the largest value falls into the last bin."""
    s = moments(df, [column])
    lo, hi = s[f"{column}_min"] or 0.0, s[f"{column}_max"] or 0.0
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if hi > lo else F.lit(0)
    counted = df.where(F.col(column).isNotNull()).select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").fillna(0, ["n"]).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"), "n"
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "var", "v")
    base = long.groupBy("var").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = q.groupBy("var").agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(a) for p, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return base.join(wide, "var")


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows that have both values; null where it is undefined, as for a constant column."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix as rows ``(a, b, r)``; all pairs come from one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    one = df.agg(*[pearson(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = []
    for k, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"c{k}").alias("r")))
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.a", "x.b", "x.r")


def redundant_pairs(corr: DataFrame, limit: float = 0.8) -> DataFrame:
    """Pairs above the limit; the alphabetically first variable is the one to keep."""
    return corr.where((F.col("a") < F.col("b")) & (F.abs("r") > limit)).select(
        F.col("a").alias("keep"), F.col("b").alias("drop"), "r"
    )


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix.

    Spark reduces the data to one row of k(k+1)/2 correlations; only that row is inverted here.  A constant
    column correlates with nothing and has 1.
    """
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1:]]
    row = df.dropna(subset=list(columns)).agg(*[pearson(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    m = np.eye(len(columns))
    at = {c: k for k, c in enumerate(columns)}
    for k, (a, b) in enumerate(pairs):
        m[at[a], at[b]] = m[at[b], at[a]] = row[f"c{k}"] or 0.0
    diagonal = np.diag(np.linalg.pinv(m))
    return df.sparkSession.createDataFrame([(c, float(diagonal[at[c]])) for c in columns], "feature string, vif double")


def kpi_summary(df: DataFrame, grade: str, top_grade: str, old_ratio: str, score: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("areas"),
        F.sum(F.when(F.col(grade) == top_grade, 1).otherwise(0)).alias("top_grade_areas"),
        (F.avg(old_ratio) * 100).alias("old_ratio_pct"),
        F.avg(score).alias("mean_risk"),
    )


def coarsen(cells: DataFrame, value: str, factor: int = 5) -> DataFrame:
    """Blocks of ``factor`` x ``factor`` cells with mean and max."""
    return cells.groupBy(
        F.floor(F.col("i") / factor).alias("bi"), F.floor(F.col("j") / factor).alias("bj")
    ).agg(F.avg(value).alias("mean_score"), F.max(value).alias("max_score"), F.count(F.lit(1)).alias("cells"))


def share_65plus(ages: DataFrame, key: str, band: str, people: str, sixties: float = 0.5) -> DataFrame:
    """People of 65 and over by district when bands are decades: the 60s count by ``sixties``."""
    w = F.when(F.col(band) >= 70, 1.0).when(F.col(band) == 60, sixties).otherwise(0.0)
    return ages.groupBy(key).agg(
        F.sum(people).alias("people"), F.try_divide(F.sum(w * F.col(people)), F.sum(people)).alias("share65")
    )


def dasymetric(cells: DataFrame, districts: DataFrame, key: str, weight: str, value: str, alias: str) -> DataFrame:
    """Spread a district value over its cells by weight.

    Weights are summed per district (partial aggregation) and joined back, so a large district
    is never one window partition.
    """
    sums = cells.groupBy(key).agg(F.sum(weight).alias("_w"))
    per = sums.join(districts.select(key, value), key, "left")
    return cells.join(per, key, "left").withColumn(
        alias, F.col(value) * F.try_divide(F.col(weight), F.col("_w"))
    ).drop("_w", value)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def coverage(found: DataFrame, expected: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """Rows found over rows expected per district."""
    f = found.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    ratio = F.col("found") / F.col("expected")
    return e.join(f, key, "left").fillna(0, ["found"]).select(
        key, "found", "expected", ratio.alias("coverage"), (ratio >= least).alias("ok")
    )


def rates(counts: DataFrame, people: str, area_km2: str, n: str = "n") -> DataFrame:
    return counts.withColumns(
        {"per_person": F.when(F.col(people) > 0, F.col(n) / F.col(people)),
         "per_km2": F.when(F.col(area_km2) > 0, F.col(n) / F.col(area_km2))}
    )


def district_rank(cells: DataFrame, district: str, score: str) -> DataFrame:
    """District mean of a score with its rank, highest first (one row per district is ranked)."""
    from rillgrid.operators.ordering import cumulate

    # rounded so that the order does not depend on the order of addition
    means = cells.groupBy(district).agg(F.round(F.avg(score), 9).alias("mean_score"))
    order = cumulate(means, "mean_score", descending=True).select(
        "mean_score", (F.col("n_before") + 1).alias("rank")
    )
    return means.join(order, "mean_score")
