"""Data behind the figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.operators import aggregates, cleaning, rain, topk
from rillgrid.plans import risk
from rillgrid.plans.aggregates_queries import _LAYERS
from rillgrid.plans.cleaning_queries import _HOLES, _holes
from rillgrid.plans.registry import R, query


@query(
    "cf1_missing_bars",
    f"""WITH h AS ({_HOLES}) SELECT 'price' AS column_name, {R('100.0 * count(*) FILTER (WHERE price IS NULL) / count(*)')} AS null_pct FROM h
        UNION ALL SELECT 'priority', {R('100.0 * count(*) FILTER (WHERE priority IS NULL) / count(*)')} FROM h""",
)
def _(r):
    return cleaning.missing_profile(_holes(r)).select("column_name", "null_pct")


@query("cf2_material_share", f"SELECT material, count(*) AS n, {R('count(*) * 100.0 / (SELECT count(*) FROM pipe)')} AS pct FROM pipe GROUP BY 1")
def _(r):
    counts = aggregates.value_counts(r.pipe, "material")
    total = r.pipe.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.select("material", "n", (F.col("n") * 100.0 / total).alias("pct"))


@query(
    "cf2_laid_year_histogram",
    f"""WITH m AS (SELECT min(laid_year) AS lo, max(laid_year) AS hi FROM pipe), b AS (SELECT CAST(least(floor((laid_year - lo) / ((hi - lo) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS n FROM pipe CROSS JOIN m GROUP BY 1)
        SELECT CAST(k.bin AS INTEGER) AS bin, {R('lo + k.bin * (hi - lo) / 30.0')} AS low, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS bin) k CROSS JOIN m LEFT JOIN b ON b.bin = k.bin""",
)
def _(r):
    return aggregates.histogram(r.pipe, "laid_year", 30)


@query("cf2_top_diameters", "SELECT diameter, count(*) AS n FROM pipe GROUP BY 1 ORDER BY n DESC, diameter LIMIT 10")
def _(r):
    return aggregates.value_counts(r.pipe, "diameter", 10)


@query("cf3_rain_pattern", f"SELECT CAST(month(ts) AS INTEGER) AS month, {R('avg(mm)')} AS mean_mm FROM rain_years GROUP BY 1")
def _(r):
    return rain.monthly_mean(r.rain_years, "ts", "mm")


@query("cf3_yearly_extremes", "SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS extremes FROM rain_years WHERE mm >= 50 GROUP BY 1")
def _(r):
    return rain.yearly_extremes(r.rain_years, "ts", "mm")


@query("cf4_grade_distribution", f"SELECT {risk.grade_fixed_sql('risk_score')} AS risk_grade, count(*) AS n FROM scored GROUP BY 1")
def _(r):
    return aggregates.value_counts(risk.scored_v1(r), "risk_grade")


@query("cf4_layer_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM scored" for a in _LAYERS for b in _LAYERS))
def _(r):
    return aggregates.corr_matrix(risk.scored_v1(r), _LAYERS)


@query("cf5_heat_points", f"SELECT i * 100 + 50 AS x, j * 100 + 50 AS y, {R('risk_score')} AS risk FROM scored WHERE risk_score IS NOT NULL")
def _(r):
    g = risk.scored_v1(r).dropna(subset=["risk_score"])
    return g.select((F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"), F.col("risk_score").alias("risk"))


@query(
    "cf5_top20_markers",
    f"SELECT i * 100 + 50 AS x, j * 100 + 50 AS y, dong, {R('risk_score')} AS risk FROM scored ORDER BY round(risk_score, 9) DESC, grid_id LIMIT 20",
)
def _(r):
    top = topk.top_n(risk.scored_v1(r).withColumn("s", F.round("risk_score", 9)), "s", "grid_id")
    return top.select((F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"), "dong", F.col("risk_score").alias("risk"))


@query(
    "cf6_rain_and_complaints",
    f"""WITH r AS (SELECT last_day(ts) AS m, sum(mm) AS rain FROM rain_years GROUP BY 1), c AS (SELECT last_day(approved) AS m, count(*) AS complaints FROM building GROUP BY 1)
        SELECT CAST(CAST(coalesce(r.m, c.m) AS DATE) AS VARCHAR) AS month_end, {R('coalesce(rain, 0)')} AS rain, coalesce(complaints, 0) AS complaints FROM r FULL OUTER JOIN c ON r.m = c.m""",
)
def _(r):
    return rain.monthly_pair(r.rain_years, r.building, "ts", "mm", "approved").withColumn("month_end", F.col("month_end").cast("string"))
