"""End-to-end chains from role views to scored cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.functions.geo import capped_distance
from rillgrid.functions.scores import bayes_shrink
from rillgrid.operators import aggregates, index, spatial, terrain
from rillgrid.operators.spatial import attach, with_cell
from rillgrid.sources.roles import Roles
from rillgrid.staging import settle

PER_CELL = 3  # pixels along a cell side


def cell_layers(r: Roles) -> list[DataFrame]:
    """One pre-aggregated layer per source, each keyed by cell."""
    pipes = aggregates.pipe_features(with_cell(r.pipe), combined="combined").select(
        "i", "j", "old_pipe_ratio", "pipe_length", "mean_diameter", "pipe_density", "combined_share"
    )
    pumps = with_cell(r.site).groupBy("i", "j").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("pump_capacity"))
    gauges = with_cell(r.complaint).groupBy("i", "j").agg(
        F.avg("mm").alias("mean_rain"), F.sum(F.when(F.col("type") == "error", 1).otherwise(0)).cast("double").alias("complaints")
    )
    ground = terrain.zonal_mean(r.dem, "z", PER_CELL, "mean_elev")
    buildings = with_cell(r.building).groupBy("i", "j").agg(
        F.avg(F.when(F.col("age") >= 30, 1.0).otherwise(0.0)).alias("old_building_ratio"),
        F.count(F.lit(1)).alias("buildings"),
        F.sum(F.when(F.col("basement"), 1).otherwise(0)).alias("basements"),
    )
    homes = with_cell(r.household).groupBy("i", "j").agg(
        F.avg(F.col("elderly").cast("double")).alias("elderly_ratio"),
        F.avg(F.col("single").cast("double")).alias("single_ratio"),
        F.count(F.lit(1)).alias("people"),
        F.sum(F.col("elderly").cast("int")).alias("elderly"),
    )
    return [pipes, pumps, gauges, ground, buildings, homes]


def grid_features(r: Roles) -> DataFrame:
    """The wide cell table of the first generation."""
    g = attach(r.grid, *cell_layers(r))
    return g.withColumn("dong", F.floor(F.col("i") / 8) * 5 + F.floor(F.col("j") / 8)).withColumns(
        {"old_building_ratio": F.coalesce("old_building_ratio", F.lit(0.0)), "pump_capacity": F.coalesce("pump_capacity", F.lit(0.0))}
    )


def feature_table(r: Roles) -> DataFrame:
    """The cell table written once: medians, extremes and scores all read it."""
    return settle(grid_features(r), "features")


def scored_v1(r: Roles) -> DataFrame:
    """All three layer scores, the weighted index and its grade."""
    return index.integrated_risk(index.layer_scores(feature_table(r)))


# The feature table and the scores in SQL.
FEATURES_SQL = """SELECT g.grid_id, g.i, g.j, (g.i // 8) * 5 + g.j // 8 AS dong,
    p.old_pipe_ratio, p.pipe_length, p.mean_diameter, p.pipe_density, p.combined_share,
    coalesce(s.pump_capacity, 0) AS pump_capacity, c.mean_rain, c.complaints, d.mean_elev,
    coalesce(b.old_building_ratio, 0) AS old_building_ratio, b.buildings, b.basements,
    h.elderly_ratio, h.single_ratio, h.people, h.elderly
  FROM grid g
  LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, avg(CASE WHEN age >= 30 THEN 1.0 ELSE 0.0 END) AS old_pipe_ratio,
      sum(length) AS pipe_length, avg(diameter) AS mean_diameter, sum(length) / 1000 / 0.01 AS pipe_density,
      sum(CASE WHEN combined THEN length ELSE 0 END) / sum(length) AS combined_share
      FROM pipe GROUP BY 1, 2) p ON p.i = g.i AND p.j = g.j
  LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, sum(value) AS pump_capacity FROM site GROUP BY 1, 2) s ON s.i = g.i AND s.j = g.j
  LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, avg(mm) AS mean_rain, CAST(count(*) FILTER (WHERE type = 'error') AS DOUBLE) AS complaints
      FROM complaint GROUP BY 1, 2) c ON c.i = g.i AND c.j = g.j
  LEFT JOIN (SELECT col // 3 AS i, row // 3 AS j, avg(z) AS mean_elev FROM dem GROUP BY 1, 2) d ON d.i = g.i AND d.j = g.j
  LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, avg(CASE WHEN age >= 30 THEN 1.0 ELSE 0.0 END) AS old_building_ratio,
      count(*) AS buildings, CAST(sum(CASE WHEN basement THEN 1 ELSE 0 END) AS BIGINT) AS basements
      FROM building GROUP BY 1, 2) b ON b.i = g.i AND b.j = g.j
  LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, avg(CASE WHEN elderly THEN 1.0 ELSE 0.0 END) AS elderly_ratio,
      avg(CASE WHEN single THEN 1.0 ELSE 0.0 END) AS single_ratio, count(*) AS people,
      CAST(sum(CASE WHEN elderly THEN 1 ELSE 0 END) AS BIGINT) AS elderly FROM household GROUP BY 1, 2) h ON h.i = g.i AND h.j = g.j"""


def mm_sql(column: str, source: str, invert: bool = False) -> str:
    """Min-max of a column over a table expression, constant to 0."""
    lo, hi = f"(SELECT min({column}) FROM {source})", f"(SELECT max({column}) FROM {source})"
    body = f"CASE WHEN {column} IS NULL THEN NULL WHEN {hi} > {lo} THEN ({column} - {lo}) / ({hi} - {lo}) ELSE 0.0 END"
    return f"(1 - {body})" if invert else f"({body})"


FILLED_SQL = """SELECT grid_id, i, j, dong, pump_capacity, coalesce(mean_rain, 0) AS mean_rain,
    coalesce(mean_elev, (SELECT quantile_cont(mean_elev, 0.5) FROM features)) AS mean_elev,
    coalesce(old_pipe_ratio, 0) AS old_pipe_ratio, coalesce(complaints, 0) AS complaints,
    coalesce(mean_diameter, (SELECT quantile_cont(mean_diameter, 0.5) FROM features)) AS mean_diameter,
    coalesce(elderly_ratio, 0) AS elderly_ratio, coalesce(single_ratio, 0) AS single_ratio, old_building_ratio,
    buildings, basements, people, elderly, pipe_density, combined_share, pipe_length FROM features"""

SCORED_SQL = f"""SELECT *, 0.4 * flood_score + 0.35 * sewer_score + 0.25 * vuln_score AS risk_score FROM (
  SELECT *, 0.4 * {mm_sql('pump_capacity', 'filled', True)} + 0.35 * {mm_sql('mean_rain', 'filled')}
       + 0.25 * {mm_sql('mean_elev', 'filled', True)} AS flood_score,
     0.4 * {mm_sql('old_pipe_ratio', 'filled')} + 0.3 * {mm_sql('mean_diameter', 'filled', True)}
       + 0.3 * {mm_sql('complaints', 'filled')} AS sewer_score,
     0.4 * {mm_sql('elderly_ratio', 'filled')} + 0.3 * {mm_sql('single_ratio', 'filled')}
       + 0.3 * {mm_sql('old_building_ratio', 'filled')} AS vuln_score FROM filled)"""


def grade_fixed_sql(score: str) -> str:
    return (
        f"CASE WHEN {score} <= 0 THEN NULL WHEN {score} <= 0.2 THEN '안전' WHEN {score} <= 0.4 THEN '관심' "
        f"WHEN {score} <= 0.6 THEN '주의' WHEN {score} <= 0.8 THEN '경계' WHEN {score} <= 1 THEN '위험' END"
    )


# -- second generation -------------------------------------------------------------------------

EXPOSURE = {"mean_rain": 1}
SENSITIVITY = {"pipe_density": 1, "mean_elev": -1, "old_pipe_ratio": 1}
RULES = ("combined_share", "pipe_density", "complaints")
PEOPLE = {"elderly_ratio": 1, "single_ratio": 1, "old_building_ratio": 1}
# the full third layer: shares of small cells pulled towards the overall share, basements, and the way to the nearest shelter
VULNERABLE = {"elderly_share": 1, "single_share": 1, "old_building_ratio": 1, "basements": 1, "shelter": 1}


def std_features(r: Roles) -> DataFrame:
    """Cells with the inputs of the second generation; every seventh district lies outside the
    treatment area and has no second layer."""
    outside = F.col("dong") % 7 == 6
    return grid_features(r).withColumns(
        {
            "universe": index.universe_flag("people", "buildings"),
            "people": F.coalesce("people", F.lit(0)), "buildings": F.coalesce("buildings", F.lit(0)),
            "basements": F.coalesce("basements", F.lit(0)), "elderly": F.coalesce("elderly", F.lit(0)),
            "complaints": F.coalesce("complaints", F.lit(0.0)),
            **{c: F.coalesce(c, F.lit(0.0)) for c in PEOPLE},
            "treated": ~outside,
        }
    )


def vulnerable_features(r: Roles) -> DataFrame:
    """Cells with the inputs of the full third layer."""
    g = settle(grid_features(r).withColumn("single", F.col("single_ratio") * F.col("people")), "people")
    t = g.agg(F.sum("people").alias("n"), F.sum("elderly").alias("elderly"), F.sum("single").alias("single")).first()
    share = lambda c: bayes_shrink(F.coalesce(c, F.lit(0)), F.coalesce("people", F.lit(0)), F.lit((t[c] or 0) / (t["n"] or 1)))
    centres = g.select("grid_id", (F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"))
    near = spatial.k_nearest(centres, r.site.select("site_id", "x", "y"), "grid_id", "site_id", 1).select("grid_id", capped_distance("d").alias("shelter"))
    return g.join(near, "grid_id", "left").select(
        "grid_id", share("elderly").alias("elderly_share"), share("single").alias("single_share"), F.coalesce("old_building_ratio", F.lit(0.0)).alias("old_building_ratio"),
        F.coalesce("basements", F.lit(0)).cast("double").alias("basements"), F.coalesce("shelter", F.lit(1.0)).alias("shelter"),
    )


def scored_std(r: Roles) -> DataFrame:
    """Layers 1 to 3, hazard, exposure and the composite index; written where it is read again."""
    g = settle(std_features(r), "std")
    g = index.layer1(g, EXPOSURE, SENSITIVITY, grades=False)
    two = index.layer2_rules(g.where("treated"), RULES).select("grid_id", "l2", "l2_additive")
    g = g.join(two, "grid_id", "left")
    g = index.layer3(g, PEOPLE).withColumn("v", F.col("l3"))
    g = settle(index.exposure(index.hazard(g), "people", "buildings"), "std-layers")
    main = index.cdri_geometric(g).select("grid_id", "cdri")
    return settle(index.with_index_grade(index.cdri_additive(g.join(main, "grid_id", "left"))), "std-scored")


def zsum_sql(source: str, columns: dict[str, int], out: str, winsor: bool) -> str:
    """Sum of z-scores over a table expression, with or without clamping to 1..99 percent."""
    clamp = {c: f"CASE WHEN s.{c} IS NULL THEN NULL ELSE least(greatest(s.{c}, q.{c}_lo), q.{c}_hi) END" if winsor else f"s.{c}" for c in columns}
    bounds = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in columns)
    stats = ", ".join(f"avg({clamp[c]}) AS {c}_avg, stddev_pop({clamp[c]}) AS {c}_std" for c in columns)
    total = " + ".join(f"coalesce({k} * ({clamp[c]} - m.{c}_avg) / nullif(m.{c}_std, 0), 0)" for c, k in columns.items())
    q = f"(SELECT {bounds} FROM {source}) q"
    return f"SELECT s.*, {total} AS {out} FROM {source} s CROSS JOIN {q} CROSS JOIN (SELECT {stats} FROM {source} s CROSS JOIN {q}) m"


STD_SQL = {
    "std_in": """SELECT grid_id, i, j, dong, mean_rain, pipe_density, mean_elev, old_pipe_ratio, combined_share,
        (coalesce(people, 0) > 0 OR coalesce(buildings, 0) >= 1) AS universe, coalesce(people, 0) AS people, coalesce(buildings, 0) AS buildings,
        coalesce(basements, 0) AS basements, coalesce(elderly, 0) AS elderly, coalesce(complaints, 0) AS complaints,
        coalesce(elderly_ratio, 0) AS elderly_ratio, coalesce(single_ratio, 0) AS single_ratio, old_building_ratio, dong % 7 <> 6 AS treated FROM features""",
    "std_e": zsum_sql("std_in", EXPOSURE, "z_exposure", True),
    "std_s": zsum_sql("std_e", SENSITIVITY, "z_sensitivity", True),
    "std_1": "SELECT *, " + mm_sql("(z_exposure + z_sensitivity)", "std_s") + " AS l1 FROM std_s",
    "std_t": "SELECT * FROM std_1 WHERE treated",
    "std_g": "SELECT grid_id, pow(" + " * ".join(f"({mm_sql(c, 'std_t')} + 0.05)" for c in RULES) + ", 1 / 3.0::DOUBLE) AS g, ("
    + " + ".join(mm_sql(c, "std_t") for c in RULES) + ") / 3 AS a FROM std_t",
    "std_2": f"SELECT grid_id, {mm_sql('g', 'std_g')} AS l2, {mm_sql('a', 'std_g')} AS l2_additive FROM std_g",
    "std_3": zsum_sql("std_1", PEOPLE, "z3", False),
    "std_x": zsum_sql("std_3", {"people": 1, "buildings": 1}, "zx", False),
    "std_h": f"""SELECT x.*, b.l2, b.l2_additive, {mm_sql('z3', 'std_x')} AS l3, {mm_sql('z3', 'std_x')} AS v, {mm_sql('zx', 'std_x')} AS e,
        CASE WHEN b.l2 IS NULL THEN l1 ELSE 0.5 * l1 + 0.5 * b.l2 END AS h, CASE WHEN b.l2 IS NULL THEN 'L1' ELSE 'L1+L2' END AS h_source
        FROM std_x x LEFT JOIN std_2 b ON b.grid_id = x.grid_id""",
    "std_p": "SELECT * FROM std_h WHERE e > 0",
    "std_c": f"""SELECT grid_id, pow(0.05 + 0.95 * {mm_sql('h', 'std_p')}, 1 / 3.0::DOUBLE) * pow(e, 1 / 3.0::DOUBLE)
        * pow(0.05 + 0.95 * {mm_sql('v', 'std_p')}, 1 / 3.0::DOUBLE) AS p FROM std_p""",
    "std": f"""SELECT h.*, c.cdri, (h.h + h.e + h.v) / 3 AS cdri_additive, CASE WHEN c.cdri IS NULL THEN NULL WHEN c.cdri < 0.01 THEN '매우낮음'
        WHEN c.cdri < 0.25 THEN '낮음' WHEN c.cdri < 0.5 THEN '보통' WHEN c.cdri < 0.75 THEN '높음' ELSE '매우높음' END AS grade
        FROM std_h h LEFT JOIN (SELECT grid_id, {mm_sql('p', 'std_c')} AS cdri FROM std_c) c ON c.grid_id = h.grid_id""",
}
