"""Per-cell and per-district aggregates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions.scores import depth_mid
from rillgrid.operators import aggregates as agg
from rillgrid.operators import spatial, terrain
from rillgrid.plans.joins_queries import PIECES_SQL
from rillgrid.plans.registry import R, query
from rillgrid.plans.risk import feature_table, grade_fixed_sql, scored_v1
from rillgrid.staging import settle


@query(
    "ag1_old_pipe_ratio",
    f"""SELECT g.grid_id, {R('avg(CASE WHEN p.age >= 30 THEN 1.0 WHEN p.age IS NOT NULL THEN 0.0 END)')} AS old_pipe_ratio
        FROM grid g LEFT JOIN pipe p ON p.x // 100 = g.i AND p.y // 100 = g.j GROUP BY 1""",
)
def _(r):
    return spatial.attach(r.grid, agg.pipe_features(spatial.with_cell(r.pipe)).select("i", "j", "old_pipe_ratio")).select("grid_id", "old_pipe_ratio")


@query("ag2_pipe_length_sum", f"SELECT x // 100 AS i, y // 100 AS j, {R('sum(length)')} AS pipe_length FROM pipe GROUP BY 1, 2")
def _(r):
    return agg.sum_per_cell(spatial.with_cell(r.pipe), "length", "pipe_length")


@query(
    "ag3_pump_capacity_sum",
    f"SELECT g.grid_id, {R('coalesce(sum(s.value), 0)')} AS pump_capacity FROM grid g LEFT JOIN site s ON s.x // 100 = g.i AND s.y // 100 = g.j GROUP BY 1",
)
def _(r):
    sums = agg.sum_per_cell(spatial.with_cell(r.site), "value", "pump_capacity")
    return spatial.attach(r.grid, sums).select("grid_id", F.coalesce("pump_capacity", F.lit(0.0)).alias("pump_capacity"))


@query(
    "ag4_old_building_ratio",
    f"SELECT x // 100 AS i, y // 100 AS j, {R('avg(CASE WHEN age >= 30 THEN 1.0 ELSE 0.0 END)')} AS old_building_ratio FROM building GROUP BY 1, 2",
)
def _(r):
    return agg.old_building_ratio(spatial.with_cell(r.building))


@query(
    "ag5_pipe_features",
    f"""SELECT x // 100 AS i, y // 100 AS j, {R('avg(CASE WHEN age >= 30 THEN 1.0 ELSE 0.0 END)')} AS old_pipe_ratio, {R('sum(length)')} AS pipe_length,
        {R('sum(CASE WHEN age >= 30 THEN length ELSE 0 END) / sum(length)')} AS old_length_share, {R('avg(age)')} AS mean_age,
        CAST(max(age) AS INTEGER) AS max_age, {R('avg(diameter)')} AS mean_diameter, min(diameter) AS min_diameter,
        {R('sum(length) / 1000 / 0.01')} AS pipe_density, {R("sum(CASE WHEN material = 'A' THEN length ELSE 0 END) / sum(length)")} AS "share_A",
        {R("sum(CASE WHEN material = 'N' THEN length ELSE 0 END) / sum(length)")} AS "share_N",
        {R('sum(CASE WHEN combined THEN length ELSE 0 END) / sum(length)')} AS combined_share FROM pipe GROUP BY 1, 2""",
)
def _(r):
    return agg.pipe_features(spatial.with_cell(r.pipe), combined="combined", materials=["A", "N"])


_DEPTH = "CASE depth_no WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 2 THEN 1.25 WHEN 3 THEN 1.75 WHEN 4 THEN 2.5 ELSE 3.5 END"


@query(
    "ag6_area_weighted_mean",
    f"""SELECT x // 800 AS town, {R(f'sum({_DEPTH} * 2.0 * h * h) / sum(2.0 * h * h)')} AS depth FROM diamond GROUP BY 1""",
)
def _(r):
    labels = F.array(*[F.lit(v) for v in ("~0.5", "0.5~1.0", "1.0~1.5", "1.5~2.0", "2.0~3.0", "3.0~")])
    d = r.diamond.select(
        F.floor(F.col("ring")[1]["x"] / 800).alias("town"), depth_mid(F.element_at(labels, (F.col("depth_no") + 1).cast("int"))).alias("mid"),
        (F.pow(F.col("ring")[0]["x"] - F.col("ring")[1]["x"], 2) * 2).alias("area"),
    )
    return agg.area_weighted_mean(d, ["town"], "mid", "area", "depth")


@query(
    "ag6_depth_per_cell",
    f"""WITH pieces AS ({PIECES_SQL}) SELECT p.i, p.j, {R(f'sum({_DEPTH} * area) / sum(area)')} AS depth
        FROM pieces p JOIN diamond d ON d.poly_id = p.poly_id WHERE area > 0 GROUP BY 1, 2""",
)
def _(r):
    """Area-weighted flood depth of every cell a depth polygon touches."""
    labels = F.array(*[F.lit(v) for v in ("~0.5", "0.5~1.0", "1.0~1.5", "1.5~2.0", "2.0~3.0", "3.0~")])
    deep = r.diamond.withColumn("mid", depth_mid(F.element_at(labels, (F.col("depth_no") + 1).cast("int"))))
    parts = spatial.cell_polygon_overlap(deep, ["poly_id", "mid"])
    return agg.area_weighted_mean(parts, ["i", "j"], "mid", "area", "depth")


@query(
    "ag7_land_cover_per_cell",
    f"""WITH pieces AS ({PIECES_SQL}) SELECT p.i, p.j, {R("sum(CASE WHEN cover LIKE '1%' THEN area ELSE 0 END) / 10000")} AS impervious,
        CAST(max((cover = '710')::INT) AS INTEGER) AS inland_water FROM pieces p JOIN diamond d ON d.poly_id = p.poly_id WHERE area > 0 GROUP BY 1, 2""",
)
def _(r):
    return agg.land_cover_share(spatial.cell_polygon_overlap(r.diamond, ["poly_id", "cover"]), "cover")


@query(
    "ag7_land_cover_share",
    f"""SELECT {R("sum(CASE WHEN cover LIKE '1%' THEN 2.0 * h * h ELSE 0 END) / 10000")} AS built_cells,
        count(*) FILTER (WHERE cover = '710') AS water_polygons FROM diamond""",
)
def _(r):
    """Built-up shares of all cells add up to the built-up area in cells."""
    shares = agg.land_cover_share(spatial.cell_polygon_overlap(r.diamond, ["poly_id", "cover"]), "cover")
    water = r.diamond.where("cover = '710'").agg(F.count(F.lit(1)).alias("n")).scalar()
    return shares.agg(F.sum("impervious").alias("built_cells"), F.max(water).alias("water_polygons"))


@query("ag8_zonal_mean", f"SELECT col // 3 AS i, row // 3 AS j, {R('avg(z)')} AS mean_elev FROM dem GROUP BY 1, 2")
def _(r):
    return terrain.zonal_mean(r.dem, "z", 3, "mean_elev")


@query(
    "ag17_value_counts",
    "SELECT diameter, count(*) AS n FROM pipe GROUP BY 1 ORDER BY n DESC, diameter LIMIT 10",
)
def _(r):
    return agg.value_counts(r.pipe, "diameter", 10)


_PRICE = "(SELECT min(o_totalprice) FROM orders)"
_WIDTH = "((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)) / 30"


@query(
    "ag18_histogram",
    f"""WITH b AS (SELECT CAST(least(floor((o_totalprice - {_PRICE}) / ({_WIDTH})), 29) AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY 1)
        SELECT CAST(k.bin AS INTEGER) AS bin, {R(f'{_PRICE} + k.bin * {_WIDTH}')} AS low, coalesce(n, 0) AS n
        FROM (SELECT unnest(range(30)) AS bin) k LEFT JOIN b ON b.bin = k.bin""",
)
def _(r):
    return agg.histogram(r.table("orders"), "o_totalprice", 30)


def _describe_sql(column: str, table: str) -> str:
    return f"""SELECT '{column}' AS var, count({column}) AS n, {R(f'avg({column})')} AS mean, {R(f'stddev_samp({column})')} AS std,
        {R(f'min({column})')} AS min, {R(f'max({column})')} AS max, {R(f'quantile_cont({column}, 0.25)')} AS q25,
        {R(f'quantile_cont({column}, 0.5)')} AS q50, {R(f'quantile_cont({column}, 0.75)')} AS q75 FROM {table}"""


@query("ag19_describe", _describe_sql("l_quantity", "lineitem") + " UNION ALL " + _describe_sql("l_extendedprice", "lineitem"))
def _(r):
    return agg.describe(r.table("lineitem"), ["l_quantity", "l_extendedprice"])


_LAYERS = ("flood_score", "sewer_score", "vuln_score", "risk_score")


@query(
    "ag20_corr_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM scored" for a in _LAYERS for b in _LAYERS),
)
def _(r):
    return agg.corr_matrix(scored_v1(r), _LAYERS)


@query(
    "ag21_redundant_pairs",
    f"""WITH m AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM scored" for a in _LAYERS for b in _LAYERS if a < b)})
        SELECT a AS keep, b AS "drop", {R('r')} AS r FROM m WHERE abs(r) > 0.3""",
)
def _(r):
    return agg.redundant_pairs(agg.corr_matrix(scored_v1(r), _LAYERS), 0.3)


def _vif_sql(a: str, b: str, c: str) -> str:
    r2 = f"(pow(corr({a}, {b}), 2) + pow(corr({a}, {c}), 2) - 2 * corr({a}, {b}) * corr({a}, {c}) * corr({b}, {c})) / (1 - pow(corr({b}, {c}), 2))"
    return f"SELECT '{a}' AS feature, {R(f'1 / (1 - {r2})')} AS vif FROM scored"


_THREE = ("flood_score", "sewer_score", "vuln_score")


@query("ag22_vif", " UNION ALL ".join(_vif_sql(*_THREE[k:], *_THREE[:k]) for k in range(3)))
def _(r):
    return agg.vif(scored_v1(r), ["flood_score", "sewer_score", "vuln_score"])


@query(
    "ag23_kpi_summary",
    f"""SELECT count(*) AS areas, count(*) FILTER (WHERE {grade_fixed_sql('risk_score')} = '주의') AS top_grade_areas,
        {R('avg(old_pipe_ratio) * 100')} AS old_ratio_pct, {R('avg(risk_score)')} AS mean_risk FROM scored""",
)
def _(r):
    return agg.kpi_summary(scored_v1(r), "risk_grade", "주의", "old_pipe_ratio", "risk_score")


@query(
    "ag24_coarsen",
    f"SELECT i // 5 AS bi, j // 5 AS bj, {R('avg(risk_score)')} AS mean_score, {R('max(risk_score)')} AS max_score, count(*) AS cells FROM scored GROUP BY 1, 2",
)
def _(r):
    return agg.coarsen(scored_v1(r), "risk_score", 5)


@query(
    "ag25_share_65plus",
    f"""SELECT dong, count(*) AS people, {R("sum(CASE WHEN band >= 70 THEN 1.0 WHEN band = 60 THEN 0.5 ELSE 0.0 END) / count(*)")} AS share65
        FROM (SELECT dong, (hh_id % 10) * 10 AS band FROM household) GROUP BY 1""",
)
def _(r):
    bands = r.household.select("dong", (F.col("hh_id") % 10 * 10).alias("band"), F.lit(1).alias("one"))
    return agg.share_65plus(bands, "dong", "band", "one")


@query(
    "ag25_single_household_share",
    f"SELECT dong, {R('avg(CASE WHEN single THEN 1.0 ELSE 0.0 END)')} AS single_share FROM household GROUP BY 1",
)
def _(r):
    return r.household.groupBy("dong").agg(F.avg(F.col("single").cast("double")).alias("single_share"))


@query(
    "ag26_dasymetric",
    f"""WITH d AS (SELECT dong, CAST(count(*) AS DOUBLE) / 0.64 AS density FROM complaint GROUP BY 1)
        SELECT f.grid_id, {R('d.density * f.people / sum(f.people) OVER (PARTITION BY f.dong)')} AS density
        FROM features f LEFT JOIN d ON d.dong = f.dong""",
)
def _(r):
    cells = feature_table(r).select("grid_id", "dong", "people")
    districts = r.complaint.groupBy("dong").agg((F.count(F.lit(1)).cast("double") / 0.64).alias("total"))
    return agg.dasymetric(cells, districts, "dong", "people", "total", "density").select("grid_id", "density")


@query(
    "ag27_crosstab",
    "SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2",
)
def _(r):
    return agg.crosstab(r.table("customer"), "c_mktsegment", "c_nationkey")


@query(
    "ag28_coverage",
    f"""WITH f AS (SELECT dong, count(*) AS found FROM building WHERE floor_area > 20000 GROUP BY 1), e AS (SELECT dong, count(*) AS expected FROM building GROUP BY 1)
        SELECT e.dong, coalesce(found, 0) AS found, expected, {R('coalesce(found, 0) * 1.0 / expected')} AS coverage, coalesce(found, 0) * 1.0 / expected >= 0.9 AS ok
        FROM e LEFT JOIN f ON f.dong = e.dong""",
)
def _(r):
    return agg.coverage(r.building.where("floor_area > 20000"), r.building, "dong")


@query(
    "ag30_rates",
    f"""WITH c AS (SELECT dong, count(*) AS n FROM complaint GROUP BY 1), h AS (SELECT dong, count(*) AS people FROM household GROUP BY 1)
        SELECT c.dong, n, coalesce(people, 0) AS people, {R('CASE WHEN people > 0 THEN n * 1.0 / people END')} AS per_person, {R('n / 0.64')} AS per_km2
        FROM c LEFT JOIN h ON h.dong = c.dong""",
)
def _(r):
    homes = agg.count_per_cell(r.household, keys=["dong"], alias="people")
    counts = agg.count_per_cell(r.complaint, keys=["dong"]).join(homes, "dong", "left").fillna(0, ["people"]).withColumn("area", F.lit(0.64))
    return agg.rates(counts, "people", "area").drop("area")


@query(
    "ag31_count_per_cell",
    """SELECT x // 100 AS i, y // 100 AS j, count(*) AS buildings, CAST(count(*) FILTER (WHERE basement) AS BIGINT) AS basements,
       CAST(count(*) FILTER (WHERE age >= 30) AS BIGINT) AS old FROM building GROUP BY 1, 2""",
)
def _(r):
    return agg.count_per_cell(
        spatial.with_cell(r.building), {"basements": F.col("basement"), "old": F.col("age") >= 30}, alias="buildings"
    )


@query(
    "ag32_district_rank",
    f"""WITH m AS (SELECT dong, round(avg(risk_score), 9) AS mean_score FROM scored GROUP BY 1)
        SELECT dong, {R('mean_score')} AS mean_score, rank() OVER (ORDER BY mean_score DESC) AS rank FROM m""",
)
def _(r):
    return agg.district_rank(scored_v1(r), "dong", "risk_score")
