"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.staging import release, settle

SPACE = r"\x20\x09-\x0D"  # the white space that separates words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL_SIDE = 50_000  # rows of a side that may be broadcast by hint, after counting


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A plain alias would be inlined by the optimizer and then evaluated once per element of a
    lambda that refers to it; a lambda variable is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Runs of anything but white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def row_key(df: DataFrame, *columns: str) -> Column:
    """A hash of ``columns``, the same in every run; with an id it tells rows apart that share the id."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns or df.columns])


def unit(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash of ``columns``."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted ``rows`` allow it; otherwise the optimizer decides by size."""
    return F.broadcast(df) if rows <= SMALL_SIDE else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v): the smallest node that can be reached."""
    spark = edges.sparkSession
    now = settle(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while True:
        # large star: neighbours above a node move to the smallest among its neighbours and itself
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct()
        up = settle(up.withColumnRenamed("v", "u").withColumnRenamed("m", "v"), "stars")  # u > v
        # small star: a node and its smaller neighbours move to the smallest of them
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u")
        moved = down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = settle(moved.distinct(), "edges")
        same = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark, up, now)
        now = new
        if tuple(same) == tuple(old):
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
