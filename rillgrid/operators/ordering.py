"""Order statistics without a single-partition window.

Equal values are counted first (a partial aggregation), distinct values are cut into ranges by
approximate quantiles, each range is scanned by its own task, and the offsets of the ranges come
from a prefix sum over one row per range.  The results are exact; only the cut points are not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.skew import HEAVY_ROWS, SHARE, salted_join
from rillgrid.staging import settle


SMALL = 500_000  # distinct values that one task may scan in order


def range_count(df: DataFrame) -> int:
    """One range per shuffle partition."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut_points(df: DataFrame, value: str, by: Sequence[str], variables: Sequence[str] | None, small: int):
    """``(cuts, rows)``: approximate quantiles that cut the values into ranges, and the row count.

    No cuts are given when there are few distinct values.  One aggregate row comes back: counts
    and a bounded number of cut points.
    """
    n = range_count(df)
    fractions = F.array(*[F.lit(k / n) for k in range(1, n)])
    parts = [F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*by, value)).alias("d")]
    names = variables or [None]
    for k, name in enumerate(names):
        v = F.col(value) if name is None else F.when(F.col(by[0]) == name, F.col(value))
        parts.append(F.percentile_approx(v, fractions, max(1000, 4 * n)).alias(f"c{k}"))
    row = df.agg(*parts).first()
    if row["d"] <= small:
        return None, row["n"]
    return {name: sorted(set(row[f"c{k}"] or [])) for k, name in enumerate(names)}, row["n"]


def _range_number(value: str, by_var: str | None, cuts) -> Column:
    """Number of cut points below the value, by binary search."""
    if cuts is None:
        return F.lit(0)

    def below(points):
        if not points:
            return F.lit(0)
        table = F.array(*[F.lit(p) for p in points])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) < F.col(value), step).otherwise(0))

    out = F.lit(0)
    for name, points in cuts.items():
        out = below(points) if name is None else F.when(F.col(by_var) == name, below(points)).otherwise(out)
    return out


def cumulate(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    descending: bool = False,
    variables: Sequence[str] | None = None,
    small: int | None = None,
) -> DataFrame:
    """One row per distinct value with ``n`` and, for every sum ``s``, the totals of the value
    (``s``), of all values before it (``s_before``) and of the whole group (``s_all``).

    ``n`` (row count) is always included.  With ``variables`` the first column of ``by`` is a
    variable name drawn from that list and every variable gets its own cut points.  Up to
    ``small`` distinct values are scanned as one range per group.
    """
    df, by = df.where(F.col(value).isNotNull()), list(by)
    by_var = by[0] if variables else None
    cuts, _ = _cut_points(df, value, by, variables, SMALL if small is None else small)
    return _scan(df, value, sums or {}, by, descending, by_var, cuts)


def _scan(df: DataFrame, value: str, sums: Mapping[str, Column], by: list[str], descending: bool, by_var: str | None, cuts) -> DataFrame:
    sums = {"n": F.lit(1), **sums}
    counted = df.groupBy(*by, value).agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    if cuts is None:
        order = F.col(value).desc() if descending else F.col(value).asc()
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        group = Window.partitionBy(*by)
        return counted.select(
            *by,
            value,
            *sums,
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(group).alias(f"{s}_all") for s in sums],
        )
    ranged = counted.withColumn("_r", _range_number(value, by_var, cuts))
    order = F.col("_r").desc() if descending else F.col("_r").asc()
    across = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = ranged.groupBy(*by, "_r").agg(*[F.sum(s).alias(s) for s in sums]).select(
        *by,
        "_r",
        *[F.coalesce(F.sum(s).over(across), F.lit(0)).alias(f"_{s}_off") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums],
    )
    inner_order = F.col(value).desc() if descending else F.col(value).asc()
    local = Window.partitionBy(*by, "_r").orderBy(inner_order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.select("*", *[F.coalesce(F.sum(s).over(local), F.lit(0)).alias(f"_{s}_loc") for s in sums])
        .join(totals, [*by, "_r"])
        .select(
            *by,
            value,
            *sums,
            *[(F.col(f"_{s}_loc") + F.col(f"_{s}_off")).alias(f"{s}_before") for s in sums],
            *[f"{s}_all" for s in sums],
        )
    )


def with_ranks(df: DataFrame, value: str, identity: Sequence[str], by: Sequence[str] = (), prefix: str = "",
               descending: bool = False) -> DataFrame:
    """Add ``rank`` (minimum), ``rank_avg`` (ties share the mean) and ``pct_rank`` columns.

    The table of distinct values already holds their row counts, which name the heavy values for
    the join back to the rows.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    cuts, rows = _cut_points(known, value, by, None, SMALL)
    positions = _scan(known, value, {}, by, descending, None, cuts)
    heavy = None
    if rows >= HEAVY_ROWS:
        positions = settle(positions, "positions")
        limit = max(float(HEAVY_ROWS), SHARE * rows)
        heavy = positions.where(F.col("n") >= limit).select(*by, value, F.lit(True).alias("_heavy"))
    ranks = positions.select(
        *by,
        value,
        (F.col("n_before") + 1).alias(f"{prefix}rank"),
        (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"{prefix}rank_avg"),
        F.when(F.col("n_all") > 1, F.col("n_before") / (F.col("n_all") - 1)).otherwise(0.0).alias(f"{prefix}pct_rank"),
    )
    return salted_join(df, ranks, [*by, value], identity, "left", rows=0, heavy=heavy)


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles as rows ``(*by, var, p, q)``.

    Few distinct values go through the built-in aggregate, whose buffer holds each of them once;
    otherwise distinct values are counted in ranges and the positions are picked.
    """
    columns, by, probs = list(columns), list(by), [float(p) for p in probs]
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "var", "_v").where(F.col("_v").isNotNull())
    cuts, _ = _cut_points(long, "_v", ["var", *by], columns, SMALL)
    if cuts is None:
        levels = F.array(*[F.lit(p) for p in probs])
        few = long.groupBy(*by, "var").agg(F.percentile("_v", levels).alias("_q"))
        pairs = few.select(*by, "var", F.explode(F.arrays_zip(levels.alias("p"), F.col("_q").alias("q"))).alias("_x"))
        return pairs.select(*by, "var", "_x.p", "_x.q")
    pos = _scan(long, "_v", {}, ["var", *by], False, "var", cuts)
    at = pos.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    at = at.withColumn("_t", (F.col("n_all") - 1) * F.col("p"))
    lo, hi = F.floor("_t"), F.ceil("_t")
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    covers_lo = (first <= lo) & (lo <= last)
    covers_hi = (first <= hi) & (hi <= last)
    at = at.where(covers_lo | covers_hi)
    picked = at.groupBy("var", *by, "p").agg(
        F.max(F.when(covers_lo, F.col("_v"))).alias("_lo"),
        F.max(F.when(covers_hi, F.col("_v"))).alias("_hi"),
        F.max(F.col("_t") - lo).alias("_f"),
    )
    return picked.select(*by, "var", "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("q"))


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> dict[str, float | None]:
    """Exact quantiles keyed ``<column>_<label>``: a few numbers, fitted like a scaler."""
    found = {(r["var"], r["p"]): r["q"] for r in quantiles(df, columns, sorted(set(probs.values()))).collect()}
    return {f"{c}_{label}": found.get((c, float(p))) for c in columns for label, p in probs.items()}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Min, max, mean, population deviation and count of every column from one aggregate row."""
    fields = []
    for c in columns:
        x = F.col(c).cast("double")
        fields += [
            F.min(x).alias(f"{c}_min"),
            F.max(x).alias(f"{c}_max"),
            F.avg(x).alias(f"{c}_avg"),
            F.stddev_pop(x).alias(f"{c}_std"),
            F.count(x).alias(f"{c}_n"),
        ]
    return df.agg(*fields).first().asDict()
