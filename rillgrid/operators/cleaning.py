"""Filters, type coercion, missing values, profiles and reshaping."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgrid.operators.ordering import quantile_values

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.DecimalType)


def filter_any_column(df: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Rows in which any column, as text, contains any keyword."""
    tests = [F.coalesce(F.col(c).cast("string").contains(k), F.lit(False)) for c in df.columns for k in keywords]
    return df.where(reduce(lambda a, b: a | b, tests))


def filter_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(F.col(column).contains(part))


def filter_code_between(df: DataFrame, column: str, low: str, high: str, digits: int = 5) -> DataFrame:
    return df.where(F.substring(column, 1, digits).between(low, high))


def filter_threshold(df: DataFrame, column: str, least: float) -> DataFrame:
    return df.where(F.col(column) >= F.lit(least))


def to_number(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    parsed = c.cast("string").try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def thousands_number(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return to_number(F.regexp_replace(c, ",", ""))


def coerce_numeric(df: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Turn text columns into DOUBLE when more than ``min_ratio`` of all rows parse.

    The parse shares of all text columns come from one aggregate with one result row.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(to_number(c)).alias(c) for c in texts]).first()
    chosen = {c for c in texts if counts[c] > counts["_all"] * min_ratio}
    return df.select(*[to_number(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


def columns_matching(df: DataFrame, parts: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def clean_rain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unreadable or empty rain is no rain."""
    return df.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in columns})


def clean_temperature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def parse_ts(column, fmt: str | None = None, strict: bool = True) -> Column:
    """Strict parsing fails the job on bad text; otherwise bad text becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    f = F.lit(fmt) if fmt else None
    if strict:
        return F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)
    return F.try_to_timestamp(c, f) if f is not None else F.try_to_timestamp(c)


def approval_year(column) -> Column:
    """Year from the first four characters of a date text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.substring(c.cast("string"), 1, 4).try_cast("int")


def trim_headers(df: DataFrame) -> DataFrame:
    """Remove blanks inside column names; repeated names get a running suffix."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"\s+", "", c)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def handle_missing(df: DataFrame, strategy: str = "drop", unknown: str = "미상") -> DataFrame:
    """Drop rows with nulls, or fill numbers with the exact median and text with ``unknown``."""
    if strategy == "drop":
        return df.dropna()
    if strategy != "fill_median":
        raise ValueError(f"unknown strategy {strategy!r}")
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]
    others = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    out = fill_median(df, numbers) if numbers else df
    return out.fillna(unknown, subset=others) if others else out


def missing_report(df: DataFrame) -> DataFrame:
    """Rows before, rows kept by dropping, rows removed; a NaN is missing too, as for dropping."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.isnan(c) if c in floats else F.lit(False)) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("before"),
        F.count(F.when(~has_null, 1)).alias("after"),
        F.count(F.when(has_null, 1)).alias("removed"),
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def fill_median(df: DataFrame, columns: Sequence[str], flag: bool = False) -> DataFrame:
    """Exact medians of all columns in one pass; ``flag`` adds ``<column>_imputed``."""
    q = quantile_values(df, columns, {"med": 0.5})
    out = {c: F.coalesce(F.col(c), F.lit(q[f"{c}_med"])) for c in columns}
    flags = {f"{c}_imputed": F.col(c).isNull() for c in columns} if flag else {}
    return df.select("*", *[v.alias(k) for k, v in flags.items()]).withColumns(out)


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns that have nulls with type and percentage, worst first."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    names = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return (
        shares.unpivot([], list(types), "column_name", "share")
        .where(F.col("share") > 0)
        .select("column_name", F.element_at(names, F.col("column_name")).alias("dtype"), (F.col("share") * 100).alias("null_pct"))
        .orderBy(F.desc("null_pct"), "column_name")
    )


def validate_dataset(df: DataFrame, expected_rows: float, tolerance: float, columns: Sequence[str],
                     max_null_share: float = 0.05, station: str | None = None) -> DataFrame:
    """One row per check: ``(rule, observed, ok)``."""
    present = [c for c in columns if c in df.columns]
    measures = [F.count(F.lit(1)).cast("double").alias("row_count")]
    measures += [F.avg(F.col(c).isNull().cast("double")).alias(f"null:{c}") for c in present]
    stats = df.agg(*measures)
    if station:
        # distinct pairs first: a plain count_distinct would expand rows per distinct aggregate
        uniques = df.select(station).where(F.col(station).isNotNull()).distinct().agg(F.count("*").cast("double").alias("n"))
        stats = stats.withColumn("stations", uniques.scalar())
    stats = stats.withColumn("columns_missing", F.lit(float(len(columns) - len(present))))
    long = stats.unpivot([], stats.columns, "rule", "observed")
    o = F.col("observed")
    ok = (
        F.when(F.col("rule") == "row_count", F.abs(o - expected_rows) <= expected_rows * tolerance)
        .when(F.col("rule") == "stations", o > 0)
        .when(F.col("rule") == "columns_missing", o == 0)
        .otherwise(o < max_null_share)
    )
    return long.withColumn("ok", F.coalesce(ok, F.lit(False)))


def unpivot_years(df: DataFrame, ids: Sequence[str], years: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(years), "year", "length")
