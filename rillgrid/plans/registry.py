"""Named queries and the SQL another engine can check them with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgrid.sources.roles import ROLE_SQL, Roles

ONCE = {"features", "filled", "scored", "hourly", "std_s", "std_1", "std_t", "std_g", "std_2", "std_x", "std_h", "std_p", "std_c", "std"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def with_roles(sql: str, views: dict[str, str] | None = None) -> str:
    """Put the views a statement names in front of it as common table expressions."""
    if views is None:
        from rillgrid.plans.risk import FEATURES_SQL, FILLED_SQL, SCORED_SQL, STD_SQL

        views = {**ROLE_SQL, "features": FEATURES_SQL, "filled": FILLED_SQL, "scored": SCORED_SQL, **STD_SQL}
    needed: list[str] = []
    open_views: set[str] = set()

    def visit(text: str) -> None:
        for name, body in views.items():
            if name not in needed and name not in open_views and re.search(rf"\b{name}\b", text):
                open_views.add(name)
                visit(body)
                needed.append(name)

    visit(sql)
    body = sql.strip()
    head = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({views[n]})" for n in needed)
    recursive = re.match(r"WITH\s+RECURSIVE\s", body)
    if recursive:
        rest = body[recursive.end():]
        return f"WITH RECURSIVE {head + ', ' if head else ''}{rest}"
    plain = re.match(r"WITH\s", body)
    if plain:
        return f"WITH {head + ', ' if head else ''}{body[plain.end():]}"
    return f"WITH {head} {body}" if head else body


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame`` under ``name``; doubles are rounded to six places."""

    def register(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, folder: tidy(fn(Roles(spark, folder)))
        if sql:
            SQL[name] = with_roles(sql)
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def R(expr: str) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
