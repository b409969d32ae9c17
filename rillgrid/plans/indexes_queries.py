"""Interpolation, scaling, layer scores, the composite index and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions.scores import class_code, grade_fixed
from rillgrid.operators import index, interpolate, normalise, spatial, topk
from rillgrid.plans import risk
from rillgrid.plans.joins_queries import _centres
from rillgrid.plans.ordering_queries import SPACED_SQL
from rillgrid.plans.registry import R, query
from rillgrid.staging import settle

_DIST = "sqrt(pow(s.x - (g.i * 100 + 50), 2) + pow(s.y - (g.j * 100 + 50), 2))"


@query(
    "in1_idw",
    f"""WITH d AS (SELECT g.grid_id, s.value, {_DIST} AS d, row_number() OVER (PARTITION BY g.grid_id ORDER BY {_DIST}, s.site_id) AS rn
          FROM grid g CROSS JOIN site s), k AS (SELECT grid_id, max(CASE WHEN rn = 1 THEN value END) AS nearest, count(*) FILTER (WHERE d <= 250) AS n,
          sum(CASE WHEN d <= 250 AND rn <= 12 THEN value / pow(greatest(d, 1e-6), 2) END) / sum(CASE WHEN d <= 250 AND rn <= 12 THEN 1 / pow(greatest(d, 1e-6), 2) END) AS v
          FROM d GROUP BY 1)
        SELECT grid_id, {R('CASE WHEN n > 0 THEN v ELSE nearest END')} AS value, n = 0 AS extrapolated FROM k""",
)
def _(r):
    """A reach of 250 m leaves cells without a station, which take the nearest value."""
    return interpolate.idw(r.site, _centres(r), "site_id", "grid_id", "value", 2.0, 12, 250.0)


_LOO = f"""WITH d AS (SELECT a.site_id, a.value AS truth, b.value, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d,
      row_number() OVER (PARTITION BY a.site_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.site_id) AS rn
      FROM site a JOIN site b ON a.site_id <> b.site_id WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 10000),
    f AS (SELECT p.p, site_id, any_value(truth) AS truth, sum(value / pow(greatest(d, 1e-6), p.p)) / sum(1 / pow(greatest(d, 1e-6), p.p)) AS guess
      FROM d CROSS JOIN (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS p) p WHERE rn <= 12 GROUP BY 1, 2),
    e AS (SELECT p AS power, count(*) AS n, sqrt(avg(pow(guess - truth, 2))) AS rmse FROM f GROUP BY 1)"""


@query("in2_idw_leave_one_out", f"{_LOO} SELECT power, n, {R('rmse')} AS rmse FROM e")
def _(r):
    return interpolate.idw_leave_one_out(r.site, "site_id", "value")


@query("in2_best_power", f"{_LOO} SELECT power, {R('rmse')} AS rmse FROM e ORDER BY rmse LIMIT 1")
def _(r):
    return interpolate.best_power(interpolate.idw_leave_one_out(r.site, "site_id", "value"))


@query(
    "nm1_minmax",
    f"""SELECT o_orderkey, {R('(o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)')} AS p,
        {R('1 - (o_custkey - (SELECT min(o_custkey) FROM orders)) * 1.0 / (SELECT max(o_custkey) - min(o_custkey) FROM orders)')} AS c, 0.0::DOUBLE AS k FROM orders""",
)
def _(r):
    o = r.table("orders").select("o_orderkey", "o_totalprice", "o_custkey", F.lit(7.0).alias("seven"))
    return normalise.minmax(o, {"o_totalprice": "p", "o_custkey": "c", "seven": "k"}, invert=["o_custkey"]).select("o_orderkey", "p", "c", "k")


@query(
    "nm2_winsorize",
    f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
        SELECT {R('min(w)')} AS low, {R('max(w)')} AS high, {R('sum(w)')} AS total FROM (SELECT least(greatest(l_extendedprice, lo), hi) AS w FROM lineitem CROSS JOIN q)""",
)
def _(r):
    w = normalise.winsorize(r.table("lineitem").select("l_extendedprice"), ["l_extendedprice"])
    return w.agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.sum("l_extendedprice").alias("total"))


@query(
    "nm3_zscore",
    f"""SELECT o_orderkey, {R('-(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)')} AS z FROM orders""",
)
def _(r):
    return normalise.zscore(r.table("orders"), {"o_totalprice": "z"}, {"o_totalprice": -1}).select("o_orderkey", "z")


@query(
    "nm4_rescale",
    f"""SELECT o_orderkey, {R('0.05 + 0.95 * (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders)')} AS s FROM orders""",
)
def _(r):
    return normalise.rescale(r.table("orders"), {"o_totalprice": "s"}).select("o_orderkey", "s")


# Exhaustive search over three cuts of the fifty pipe lengths is the check of the exact breaks.
@query(
    "nm5_jenks_exact",
    f"""WITH v AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT v, n, sum(n) OVER w AS cn, sum(n * v) OVER w AS cs, sum(n * v * v) OVER w AS cq FROM v WINDOW w AS (ORDER BY v)),
        t AS (SELECT max(cn) AS cn, max(cs) AS cs, max(cq) AS cq FROM c),
        g AS (SELECT a.v AS b1, b.v AS b2, d.v AS b3, a.cq - a.cs * a.cs / a.cn + (b.cq - a.cq) - pow(b.cs - a.cs, 2) / (b.cn - a.cn)
          + (d.cq - b.cq) - pow(d.cs - b.cs, 2) / (d.cn - b.cn) + (t.cq - d.cq) - pow(t.cs - d.cs, 2) / (t.cn - d.cn) AS sse
          FROM c a JOIN c b ON b.v > a.v JOIN c d ON d.v > b.v CROSS JOIN t WHERE d.cn < t.cn),
        best AS (SELECT b1, b2, b3 FROM g ORDER BY sse LIMIT 1)
        SELECT CAST(1 + (l_quantity > b1)::INT + (l_quantity > b2)::INT + (l_quantity > b3)::INT AS INTEGER) AS class, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high
        FROM lineitem CROSS JOIN best GROUP BY 1""",
)
def _(r):
    li = r.table("lineitem").select("l_quantity")
    coded = li.withColumn("class", class_code("l_quantity", normalise.jenks_breaks(li, "l_quantity", 4)))
    return coded.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def jenks_sql(tag: str, source: str, column: str, k: int) -> str:
    """The Fisher recurrence over all distinct values as common table expressions ending in ``<tag>_cuts``."""
    t = tag
    parts = [
        f"{t}_v AS MATERIALIZED (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)",
        f"{t}_h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v) AS p, v AS top, n, n * (v - m) AS s, n * (v - m) * (v - m) AS q "
        f"FROM {t}_v CROSS JOIN (SELECT sum(v * n) / sum(n) AS m FROM {t}_v))",
        f"{t}_c AS MATERIALIZED (SELECT p, top, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM {t}_h WINDOW w AS (ORDER BY p) UNION ALL SELECT 0, NULL, 0, 0, 0)",
        f"{t}_1 AS MATERIALIZED (SELECT p, q - s * s / n AS cost FROM {t}_c WHERE p > 0)",
    ]
    for m in range(2, k + 1):
        parts.append(
            f"{t}_{m} AS MATERIALIZED (SELECT j.p, min(d.cost + (j.q - i.q) - pow(j.s - i.s, 2) / (j.n - i.n)) AS cost, "
            f"arg_min(i.p, d.cost + (j.q - i.q) - pow(j.s - i.s, 2) / (j.n - i.n)) AS cut FROM {t}_c j JOIN {t}_c i ON i.p < j.p JOIN {t}_{m - 1} d ON d.p = i.p GROUP BY 1)"
        )
    last = f"(SELECT max(p) FROM {t}_h)"
    for m in range(k, 1, -1):
        parts.append(f"{t}_b{m} AS (SELECT cut AS p FROM {t}_{m} WHERE p = {last})")
        last = f"(SELECT p FROM {t}_b{m})"
    cuts = " UNION ALL ".join(f"SELECT top FROM {t}_c WHERE p = (SELECT p FROM {t}_b{m})" for m in range(2, k + 1))
    parts.append(f"{t}_cuts AS MATERIALIZED ({cuts})")
    return ", ".join(parts)


@query(
    "nm5_jenks_binned",
    f"""WITH {jenks_sql('k', 'orders', 'o_totalprice', 5)}
        SELECT CAST(1 + (SELECT count(*) FROM k_cuts WHERE o_totalprice > top) AS INTEGER) AS class, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1""",
)
def _(r):
    """Five natural classes of a column with many distinct values, against the recurrence over all of them."""
    o = r.table("orders").select("o_totalprice")
    coded = o.withColumn("class", class_code("o_totalprice", normalise.jenks_breaks(o, "o_totalprice", 5)))
    return coded.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("nm6_max_norm", f"SELECT o_orderkey, {R('o_totalprice / (SELECT max(o_totalprice) FROM orders)')} AS m FROM orders")
def _(r):
    return normalise.max_norm(r.table("orders"), {"o_totalprice": "m"}).select("o_orderkey", "m")


@query("sc1_flood_score", f"SELECT grid_id, {R('flood_score')} AS flood_score FROM scored")
def _(r):
    return index.flood_score(risk.feature_table(r)).select("grid_id", "flood_score")


@query("sc2_sewer_score", f"SELECT grid_id, {R('sewer_score')} AS sewer_score FROM scored")
def _(r):
    return index.sewer_score(risk.feature_table(r)).select("grid_id", "sewer_score")


@query(
    "sc2_sewer_score_without_complaints",
    f"SELECT grid_id, {R('0.55 * ' + risk.mm_sql('old_pipe_ratio', 'filled') + ' + 0.45 * ' + risk.mm_sql('mean_diameter', 'filled', True))} AS sewer_score FROM filled",
)
def _(r):
    return index.sewer_score(risk.feature_table(r).drop("complaints")).select("grid_id", "sewer_score")


@query("sc3_vulnerability_score", f"SELECT grid_id, {R('vuln_score')} AS vuln_score FROM scored")
def _(r):
    return index.vulnerability_score(risk.feature_table(r)).select("grid_id", "vuln_score")


@query("sc4_integrated_risk", f"SELECT grid_id, {R('risk_score')} AS risk_score, {risk.grade_fixed_sql('risk_score')} AS risk_grade FROM scored")
def _(r):
    return risk.scored_v1(r).select("grid_id", "risk_score", "risk_grade")


@query("sc5_layer1", f"SELECT grid_id, {R('z_exposure')} AS z_exposure, {R('z_sensitivity')} AS z_sensitivity, {R('l1')} AS l1 FROM std_1")
def _(r):
    g = settle(risk.std_features(r), "std")
    return index.layer1(g, risk.EXPOSURE, risk.SENSITIVITY, grades=False).select("grid_id", "z_exposure", "z_sensitivity", "l1")


@query(
    "sc5_layer1_grades",
    f"""WITH {jenks_sql('x', 'std_1', 'z_exposure', 4)}, {jenks_sql('s', 'std_1', 'z_sensitivity', 4)},
        g AS (SELECT l1, 4 - (SELECT count(*) FROM x_cuts WHERE z_exposure > top) AS e, 4 - (SELECT count(*) FROM s_cuts WHERE z_sensitivity > top) AS s FROM std_1),
        m(e, s, grade) AS (VALUES (1,1,1),(1,2,1),(1,3,2),(1,4,2),(2,1,1),(2,2,2),(2,3,2),(2,4,3),(3,1,2),(3,2,2),(3,3,3),(3,4,4),(4,1,2),(4,2,3),(4,3,4),(4,4,4))
        SELECT CAST(m.grade AS INTEGER) AS l1_grade, count(*) AS n, {R('avg(l1)')} AS mean_l1 FROM g JOIN m ON m.e = g.e AND m.s = g.s GROUP BY 1""",
)
def _(r):
    g = index.layer1(settle(risk.std_features(r), "std"), risk.EXPOSURE, risk.SENSITIVITY)
    return g.groupBy("l1_grade").agg(F.count(F.lit(1)).alias("n"), F.avg("l1").alias("mean_l1"))


@query("sc6_layer2_rules", f"SELECT grid_id, {R('l2')} AS l2, {R('l2_additive')} AS l2_additive FROM std_2")
def _(r):
    g = settle(risk.std_features(r), "std").where("treated")
    return index.layer2_rules(g, risk.RULES).select("grid_id", "l2", "l2_additive")


@query(
    "sc7_layer3_grades",
    f"""WITH n AS MATERIALIZED (SELECT g.grid_id, least(min({_DIST}), 2000) / 2000 AS shelter FROM grid g CROSS JOIN site s GROUP BY 1),
        o AS (SELECT sum(elderly) * 1.0 / sum(people) AS pe, sum(single_ratio * people) / sum(people) AS ps FROM features),
        w AS MATERIALIZED (SELECT f.grid_id, (coalesce(elderly, 0) + 20 * pe) / (coalesce(people, 0) + 20) AS elderly_share,
          (coalesce(single_ratio * people, 0) + 20 * ps) / (coalesce(people, 0) + 20) AS single_share, old_building_ratio, CAST(coalesce(basements, 0) AS DOUBLE) AS basements, shelter
          FROM features f JOIN n ON n.grid_id = f.grid_id CROSS JOIN o),
        z AS MATERIALIZED ({risk.zsum_sql("w", risk.VULNERABLE, "z3", False)}), l AS MATERIALIZED (SELECT *, {risk.mm_sql("z3", "z")} AS l3 FROM z), {jenks_sql("c", "l", "l3", 4)}
        SELECT grid_id, {R("elderly_share")} AS elderly_share, {R("shelter")} AS shelter, {R("l3")} AS l3, CAST(1 + (SELECT count(*) FROM c_cuts WHERE l3 > top) AS INTEGER) AS l3_grade FROM l""",
)
def _(r):
    """The full third layer: shrunk shares, old buildings, basements and the way to a shelter, in four natural classes."""
    return index.layer3(risk.vulnerable_features(r), risk.VULNERABLE, 4).select("grid_id", "elderly_share", "shelter", "l3", "l3_grade")


@query("sc7_layer3", f"SELECT grid_id, {R('l3')} AS l3 FROM std_h")
def _(r):
    return index.layer3(settle(risk.std_features(r), "std"), risk.PEOPLE).select("grid_id", "l3")


@query("sc8_hazard", f"SELECT grid_id, {R('h')} AS h, h_source FROM std")
def _(r):
    return risk.scored_std(r).select("grid_id", "h", "h_source")


@query("sc9_exposure", f"SELECT grid_id, {R('e')} AS e, e > 0 AS ranked FROM std")
def _(r):
    g = index.exposure(settle(risk.std_features(r), "std"), "people", "buildings")
    return g.select("grid_id", "e", (F.col("e") > 0).alias("ranked"))


@query("sc10_cdri_geometric", f"SELECT grid_id, {R('cdri')} AS cdri, grade FROM std WHERE cdri IS NOT NULL")
def _(r):
    return risk.scored_std(r).where("cdri is not null").select("grid_id", "cdri", "grade")


@query("sc11_cdri_additive", f"SELECT grid_id, {R('cdri_additive')} AS cdri_additive FROM std")
def _(r):
    return risk.scored_std(r).select("grid_id", "cdri_additive")


@query("sc12_universe_flag", "SELECT grid_id, universe FROM std_in")
def _(r):
    return risk.std_features(r).select("grid_id", "universe")


_PARTS = {"h": 1 / 3, "e": 1 / 3, "v": 1 / 3}


@query(
    "sc13_contribution",
    f"""WITH p AS (SELECT *, h + e + v AS total, percent_rank() OVER (ORDER BY round(h, 9)) AS ph, percent_rank() OVER (ORDER BY round(e, 9)) AS pe,
          percent_rank() OVER (ORDER BY round(v, 9)) AS pv FROM std WHERE cdri IS NOT NULL)
        SELECT grid_id, {R('round(h, 9) / (round(h, 9) + round(e, 9) + round(v, 9)) * 100')} AS pct_h, {R('round(e, 9) / (round(h, 9) + round(e, 9) + round(v, 9)) * 100')} AS pct_e,
        CASE WHEN ph >= pe AND ph >= pv THEN 'h' WHEN pe >= pv THEN 'e' ELSE 'v' END AS main_cause FROM p""",
)
def _(r):
    g = risk.scored_std(r).where("cdri is not null").select("grid_id", *[F.round(c, 9).alias(c) for c in _PARTS])
    return index.contribution(g, _PARTS, "grid_id").select("grid_id", "pct_h", "pct_e", "main_cause")


_CARD_DIST = "sqrt(pow(s.x - (c.i * 100 + 50), 2) + pow(s.y - (c.j * 100 + 50), 2))"


@query(
    "sc14_top20_card",
    SPACED_SQL.replace("round(risk_score, 9)", "round(cdri, 9)").replace("FROM scored", "FROM std WHERE cdri IS NOT NULL")
    + f""", n AS (SELECT c.grid_id, s.site_id, {_CARD_DIST} AS d, row_number() OVER (PARTITION BY c.grid_id ORDER BY {_CARD_DIST}, s.site_id) AS rn
          FROM c JOIN picks USING (grid_id) CROSS JOIN site s)
        SELECT t.grid_id, t.dong, {R('t.cdri')} AS cdri, n.site_id AS pump, {R('n.d')} AS pump_distance, t.people, t.elderly, t.basements,
          CAST(t.complaints AS DOUBLE) AS complaints FROM std t JOIN picks USING (grid_id) JOIN n ON n.grid_id = t.grid_id AND n.rn = 1""",
)
def _(r):
    g = risk.scored_std(r).where("cdri is not null")
    cells = g.select("grid_id", (F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"), F.round("cdri", 9).alias("s"))
    picks = topk.top_n_spaced(cells, "s", "grid_id", 20, 300.0)
    pumps = spatial.k_nearest(picks, r.site, "grid_id", "site_id", 1).select("grid_id", F.col("site_id").alias("pump"), F.col("d").alias("pump_distance"))
    return g.join(picks.select("grid_id"), "grid_id", "left_semi").join(pumps, "grid_id").select(
        "grid_id", "dong", "cdri", "pump", "pump_distance", "people", "elderly", "basements", "complaints"
    )


@query("sc15_fvi_ratio", f"SELECT grid_id, {R('e * l1 / nullif(1 - v, 0)')} AS fvi FROM std")
def _(r):
    g = risk.scored_std(r).withColumn("resilience", 1 - F.col("v"))
    return g.select("grid_id", index.fvi_ratio("e", "l1", "resilience").alias("fvi"))


def _entropy(c: str) -> str:
    t = f"({c} + 1e-9)"
    return f"(SELECT -sum({t} / tot * ln({t} / tot)) / ln(count(*)) FROM std_h CROSS JOIN (SELECT sum({t}) AS tot FROM std_h) x)"


@query(
    "wt1_entropy_weights",
    "WITH e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS var, {_entropy(c)} AS e" for c in ("h", "e", "v")) + f") SELECT var, {R('e')} AS e, {R('(1 - e) / sum(1 - e) OVER ()')} AS w FROM e",
)
def _(r):
    return index.entropy_weights(risk.scored_std(r), ["h", "e", "v"])


_ANSWERS = """answers AS (SELECT c_custkey AS respondent, 1 AS i, 2 AS j, (1 + c_custkey % 3)::DOUBLE AS value FROM customer
  UNION ALL SELECT c_custkey, 1, 3, (2 + c_custkey % 4)::DOUBLE FROM customer UNION ALL SELECT c_custkey, 2, 3, (1 + c_custkey % 2)::DOUBLE FROM customer),
  every_pair AS (SELECT i, j, value FROM answers UNION ALL SELECT j, i, 1 / value FROM answers UNION ALL SELECT unnest([1, 2, 3]), unnest([1, 2, 3]), 1.0),
  pooled AS (SELECT i, j, exp(avg(ln(value))) AS a FROM every_pair GROUP BY 1, 2), g AS (SELECT i, exp(avg(ln(a))) AS g FROM pooled GROUP BY 1),
  w AS (SELECT i, g / sum(g) OVER () AS w FROM g), lam AS (SELECT avg(aw / w.w) AS l FROM (SELECT p.i, sum(p.a * w.w) AS aw FROM pooled p JOIN w ON w.i = p.j GROUP BY 1) x JOIN w ON w.i = x.i)"""


def ahp_answers(r):
    """Every customer answers the three pairs; the lower triangle and the diagonal follow."""
    k = F.col("c_custkey")
    pair = lambda i, j, v: F.array(
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.cast("double").alias("value")),
        F.struct(F.lit(j).alias("i"), F.lit(i).alias("j"), (1 / v.cast("double")).alias("value")),
    )
    same = F.array(*[F.struct(F.lit(n).alias("i"), F.lit(n).alias("j"), F.lit(1.0).alias("value")) for n in (1, 2, 3)])
    rows = F.concat(pair(1, 2, 1 + k % 3), pair(1, 3, 2 + k % 4), pair(2, 3, 1 + k % 2), same)
    return r.table("customer").select(k.alias("respondent"), F.explode(rows).alias("a")).select("respondent", "a.*")


@query("wt2_ahp_weights", f"WITH {_ANSWERS} SELECT CAST(i AS INTEGER) AS item, {R('w')} AS w, {R('(l - 3) / 2 / 0.58')} AS cr FROM w CROSS JOIN lam")
def _(r):
    return index.ahp_weights(ahp_answers(r))
