"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.002  # of all rows: at most 1/SHARE keys can hold more
HEAVY_ROWS = 100_000  # a key with fewer rows is no burden for one task


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE, least: int | None = None) -> DataFrame | None:
    """Keys with more than ``share`` of all rows and at least ``least`` rows, or None.

    Counting is a partial aggregation over the key columns whose summary is one row.  At most
    ``1/share`` keys can qualify, so the result may be broadcast whatever the size of ``df``.
    """
    least = HEAVY_ROWS if least is None else least
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counts = df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    summary = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    limit = max(float(least), (summary["total"] or 0) * share)
    if (summary["top"] or 0) < limit:
        return None
    return counts.where(F.col("_n") >= limit).select(*keys, F.lit(True).alias("_heavy"))


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    identity: Sequence[str],
    how: str = "inner",
    salts: int = 64,
    share: float = SHARE,
    least: int | None = None,
    rows: int | None = None,
    heavy: DataFrame | None = None,
    large: bool = False,
) -> DataFrame:
    """Equi-join ``many`` with ``few``; keys that hold too many rows of ``many`` are salted.

    The key counts are looked at first.  Without heavy keys this is the plain join.  Otherwise the
    rows of a heavy key are spread by the hash of ``identity`` (columns that tell rows of one key
    apart, so a retried task picks the same salt) and the rows of ``few`` are repeated per salt for
    heavy keys only.  Rows without a key match nothing and are spread too.  ``how`` may be any type
    that keeps ``many`` on the left.  Where the caller knows that ``many`` has at most ``rows`` rows,
    or already has its ``heavy`` keys (as from ``heavy_keys``), nothing is counted.  With ``large`` both
    tables are shuffled: the optimizer's size checks go by compressed files, of which a few megabytes
    can hold more rows than a broadcast bears.
    """
    keys = list(keys)
    least = HEAVY_ROWS if least is None else least
    if heavy is None and (rows is None or rows >= least):
        heavy = heavy_keys(many, keys, share, least)
    if heavy is None:
        return many.join(few.hint("merge") if large else few, keys, how)
    heavy = F.broadcast(heavy)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.pmod(F.xxhash64(*identity), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    left = many.join(heavy, keys, "left").withColumn("_salt", F.when(F.col("_heavy") | missing, salt).otherwise(0)).drop("_heavy")
    right = few.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_heavy"), every).otherwise(F.array(F.lit(0))))
    ).drop("_heavy")
    return left.join(right.hint("merge") if large else right, [*keys, "_salt"], how).drop("_salt")
