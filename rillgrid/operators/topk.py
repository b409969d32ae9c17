"""Top lists, with and without spacing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.operators.ordering import with_ranks
from rillgrid.session import ship
from rillgrid.staging import release, settle

OPEN, KEPT, GONE = 0, 1, 2


def top_n(df: DataFrame, score: str, key: str, n: int = 20) -> DataFrame:
    """Highest scores first, ties by key; runs as TakeOrderedAndProject."""
    return df.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.col(key)).limit(n)


def top_share(df: DataFrame, score: str, key: str, share: float = 0.2) -> DataFrame:
    """Flag the best-scored share by percent rank."""
    return with_ranks(df.where(F.col(score).isNotNull()), score, [key]).withColumn(
        "in_top", F.col("pct_rank") >= F.lit(1 - share)
    )


def _settle_tile(reach: float):
    """Decide a tile's open cells from the best down, as far as its own cells and its margin tell."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["s", "k"], ascending=[False, True], kind="stable")
        kept: dict[tuple[int, int], list] = {}
        unsure: dict[tuple[int, int], list] = {}
        states = []
        for x, y, own, status in zip(cells["x"], cells["y"], cells["own"], cells["status"], strict=True):
            at = (int(x // reach), int(y // reach))

            def near(table):
                for i in (at[0] - 1, at[0], at[0] + 1):
                    for j in (at[1] - 1, at[1], at[1] + 1):
                        for u, v in table.get((i, j), ()):
                            if (u - x) ** 2 + (v - y) ** 2 <= reach**2:
                                return True
                return False

            if status == OPEN and near(kept):
                status = GONE
            elif status == OPEN and own and not near(unsure):
                status = KEPT
            if status != GONE:
                (kept if status == KEPT else unsure).setdefault(at, []).append((x, y))
            states.append(status)
        cells["status"] = states
        return cells.loc[cells["own"], ["k", "x", "y", "s", "status"]]

    return run


def _suppressed(cells: DataFrame, score: str, key: str, reach: float, tile: float, first: int | None) -> DataFrame:
    """Rounds of tile decisions until no cell is open, or ``first`` kept cells outrank all open ones.

    In each round every cell goes to its tile and, within ``reach`` of a border, to the tiles beside it.
    A task walks its tile from the best cell down.  The best open cell of all is decided in every
    round, and chains of cells are followed through whole tiles; the tiles move by half a side
    from round to round.
    """
    ship(cells.sparkSession)
    spark = cells.sparkSession
    state = settle(
        cells.where(F.col(score).isNotNull()).select(F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(score).cast("double").alias("s"), F.lit(OPEN).alias("status")),
        "nodes",
    )
    steps = F.array(*[F.lit(float(d)) for d in (-reach, 0, reach)])
    turn = 0
    while True:
        shift = F.lit(tile / 2 * (turn % 2))
        at = lambda c, d: F.floor((F.col(c) + shift + d) / tile)
        seen = state.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(
            "k", "x", "y", "s", "status", at("x", F.col("dx")).alias("ti"), at("y", F.col("dy")).alias("tj"),
            ((at("x", F.col("dx")) == at("x", F.lit(0.0))) & (at("y", F.col("dy")) == at("y", F.lit(0.0)))).alias("own"),
        ).distinct()
        fresh = settle(seen.groupBy("ti", "tj").applyInPandas(_settle_tile(reach), state.schema), "state")
        release(spark, state)
        state, turn = fresh, turn + 1
        best_open = state.where(F.col("status") == OPEN).orderBy(F.desc("s"), "k").select("s", "k").first()
        if best_open is None:
            return state
        if first is not None:
            above = (F.col("s") > F.lit(best_open["s"])) | ((F.col("s") == F.lit(best_open["s"])) & (F.col("k") < F.lit(best_open["k"])))
            if state.where((F.col("status") == KEPT) & above).limit(first).count() == first:
                return state


def _kept(state: DataFrame, score: str, key: str) -> DataFrame:
    return state.where(F.col("status") == KEPT).select(F.col("k").alias(key), "x", "y", F.col("s").alias(score))


def suppress_neighbours(cells: DataFrame, score: str, key: str, reach: float = 300.0, tile: float = 30_000.0) -> DataFrame:
    """The set that picking the best cell, dropping all within ``reach`` and repeating would keep.

    Input: ``key, x, y, score``.  A tile of side ``tile`` is one group; on a 100 m grid it holds 90,000 cells.
    """
    return _kept(_suppressed(cells, score, key, reach, tile, None), score, key)


def top_n_spaced(cells: DataFrame, score: str, key: str, n: int = 20, reach: float = 300.0, tile: float = 30_000.0) -> DataFrame:
    """First ``n`` cells of the spaced list; stops when they are known."""
    return top_n(_kept(_suppressed(cells, score, key, reach, tile, n), score, key), score, key, n)


def set_overlap(a: DataFrame, b: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Share of ``n`` keys present in both lists, in percent."""
    return a.select(key).intersect(b.select(key)).agg(
        F.count(F.lit(1)).alias("shared"), (F.count(F.lit(1)) / F.lit(n) * 100).alias("overlap_pct")
    )


def not_in(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")
