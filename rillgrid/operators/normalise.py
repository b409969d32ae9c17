"""Scaling of score columns: fit one row of statistics, then apply plain column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.operators.ordering import moments, quantile_values
from rillgrid.staging import release, settle


def _scaled(c: str, s: Mapping[str, float | None]) -> Column:
    lo, hi = s[f"{c}_min"], s[f"{c}_max"]
    if lo is None:
        return F.lit(None).cast("double")
    scaled = (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.0)
    return F.when(F.col(c).isNotNull(), scaled)


def minmax(df: DataFrame, columns: Mapping[str, str], invert: Sequence[str] = ()) -> DataFrame:
    """``columns`` maps input to output names.  A constant column gives 0, inverted 1."""
    s = moments(df, list(columns))
    return df.withColumns({out: (1 - _scaled(c, s)) if c in invert else _scaled(c, s) for c, out in columns.items()})


def rescale(df: DataFrame, columns: Mapping[str, str], low: float = 0.05) -> DataFrame:
    """Min-max into ``[low, 1]``."""
    s = moments(df, list(columns))
    return df.withColumns({out: F.lit(low) + F.lit(1 - low) * _scaled(c, s) for c, out in columns.items()})


def max_norm(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    s = moments(df, list(columns))
    return df.withColumns({out: F.try_divide(F.col(c), F.lit(s[f"{c}_max"])) for c, out in columns.items()})


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clamp to exact interpolated percentiles; nulls stay null."""
    q = quantile_values(df, list(columns), {"lo": low, "hi": high})
    clamp = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(q[f"{c}_lo"])), F.lit(q[f"{c}_hi"])))
        for c in columns
    }
    return df.withColumns(clamp)


def zscore(df: DataFrame, columns: Mapping[str, str], signs: Mapping[str, int] | None = None) -> DataFrame:
    """Population z-score, sign +1 where larger is worse; a constant column gives 0."""
    s = moments(df, list(columns))
    signs = signs or {}

    def z(c):
        std = s[f"{c}_std"]
        scaled = F.lit(float(signs.get(c, 1))) * (F.col(c) - F.lit(s[f"{c}_avg"])) / F.lit(std) if std else F.lit(0.0)
        return F.when(F.col(c).isNotNull(), scaled)

    return df.withColumns({out: z(c) for c, out in columns.items()})


BINS = 512  # rows of a summary before its cuts are refined
SPLIT = 16  # parts of a bin that is split


def _summary(values: DataFrame, edges: list[float], center: float) -> list:
    """A row per bin of ``values`` (v, n) between ``edges``: greatest value, distinct values, sums around ``center``, and values that split it."""
    number = F.lit(0)
    if edges:
        table = F.lit(edges)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
        number = F.aggregate(steps, number, lambda at, step: at + F.when(F.get(table, at + step - 1) < F.col("v"), step).otherwise(0))
    off = F.col("v") - F.lit(center)
    found = values.groupBy(number.alias("b")).agg(
        F.max("v").alias("top"), F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.sum(F.col("n") * off).alias("s"), F.sum(F.col("n") * off * off).alias("q"),
        F.percentile_approx("v", [k / SPLIT for k in range(1, SPLIT)], 1000).alias("parts"),
    )
    return sorted(found.collect(), key=lambda r: r["top"])  # at most as many rows as edges, and one


def _cuts(rows: list, k: int) -> list[int]:
    """The last row of all classes but the greatest, for the ``k`` classes of the least squared deviation (Fisher's recurrence)."""
    n, s, q = (np.concatenate([[0.0], np.cumsum([float(r[f]) for r in rows])]) for f in ("n", "s", "q"))

    def spread(i, j):
        """Squared deviation of the summary rows i..j-1 around their mean, for an array of i."""
        return (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i])

    size = len(rows)
    cost = np.array([np.inf] + [spread(0, j) for j in range(1, size + 1)])
    chosen = []
    for part in range(2, k + 1):
        best, where = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=int)
        for j in range(part, size + 1):
            i = np.arange(part - 1, j)
            total = cost[i] + spread(i, j)
            pick = int(np.argmin(total))
            best[j], where[j] = total[pick], i[pick]
        cost = best
        chosen.append(where)
    out, j = [], size
    for where in reversed(chosen):
        j = int(where[j])
        out.append(j - 1)
    return out[::-1]


def jenks_breaks(df: DataFrame, column: str, classes: int = 4) -> list[float]:
    """Upper bounds of all natural classes but the last.

    Equal values are counted, and Spark reduces them to bins.  A bin is split at quantiles of its distinct values, those of the greatest
    squared deviation first, until each holds one value or there are ``BINS``; so neither a far value nor a long tail
    merges the others.  Fisher's recurrence runs on the bins, those on both sides of its breaks are split
    further, and it runs again, until single values lie there.  Up to ``BINS`` distinct values the breaks are exact however they are
    spread; beyond, they are exact but for breaks elsewhere that are as good within the width of a bin.  Nulls and NaN
    do not count.  A constant or empty column has no breaks.
    """
    v = F.col(column).cast("double")
    values = settle(df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy("v").agg(F.count(F.lit(1)).alias("n")), "values")
    spark, total = df.sparkSession, values.agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s")).first()
    if not total["n"]:
        release(spark, values)
        return []
    edges, center = [], total["s"] / total["n"]
    while True:
        rows = _summary(values, edges, center)
        k = min(classes, len(rows))
        mixed = [r for r in rows if r["d"] > 1]
        if mixed and len(rows) < BINS:
            mixed.sort(key=lambda r: (r["s"] ** 2 / r["n"] - r["q"], r["top"]))
            mixed = mixed[: max(1, (BINS - len(rows)) // (SPLIT - 1))]
        else:
            cuts = _cuts(rows, k) if k > 1 else []
            mixed = [rows[i] for i in sorted({x for c in cuts for x in (c, c + 1)}) if rows[i]["d"] > 1]
            if not mixed:
                release(spark, values)
                return [float(rows[c]["top"]) for c in cuts]
        tops = {r["top"] for r in rows[:-1]}
        edges = sorted(tops.union(p for r in mixed for p in r["parts"] if p < r["top"]))
