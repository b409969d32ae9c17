"""Validation metrics and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions.text import classify_keyword
from rillgrid.operators import index, spatial, topk, validate
from rillgrid.operators.normalise import jenks_breaks, max_norm, minmax
from rillgrid.plans import risk
from rillgrid.plans.functions_queries import PATTERNS, _match
from rillgrid.plans.indexes_queries import jenks_sql
from rillgrid.plans.registry import R, query

_LAB = "SELECT l.doc_id, quality AS y, n_chars AS s, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _labelled(r):
    return r.table("labels").join(r.table("documents").select("doc_id", "n_chars", "text"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("s"), "toxic", "text"
    )


@query(
    "vl1_roc_auc",
    f"""WITH l AS ({_LAB}), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM l)
        SELECT {R('(sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))')} AS auc,
        count(*) FILTER (WHERE y = 1) AS positives, count(*) AS n FROM k""",
)
def _(r):
    return validate.roc_auc(_labelled(r), "y", "s")


_AP = """p AS (SELECT s, count(*) FILTER (WHERE y = 1) AS tp, count(*) AS n FROM l GROUP BY 1),
  c AS (SELECT s, tp, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(tp) OVER () AS all_tp, sum(n) OVER () AS all_n FROM p)"""


@query("vl2_pr_auc", f"WITH l AS ({_LAB}), {_AP} SELECT {R('sum(tp / all_tp * ctp / cn)')} AS average_precision, {R('max(all_tp / all_n)')} AS positive_rate FROM c")
def _(r):
    return validate.pr_auc(_labelled(r), "y", "s")


@query("vl3_brier", f"WITH l AS ({_LAB}) SELECT {R('avg(pow(least(s / 20000.0, 1.0) - y, 2))')} AS brier FROM l")
def _(r):
    return validate.brier(_labelled(r).withColumn("p", F.least(F.col("s") / 20000.0, F.lit(1.0))), "y", "p")


_S = "round(risk_score, 9)"


@query(
    "vl4_lift",
    f"""SELECT {R("avg(CASE WHEN dong % 25 IN (3, 8, 12, 17, 21) THEN (risk_score > 0.4)::INT END)")} AS case_share, {R("avg((risk_score > 0.4)::INT)")} AS all_share,
        {R("avg(CASE WHEN dong % 25 IN (3, 8, 12, 17, 21) THEN (risk_score > 0.4)::INT END) / avg((risk_score > 0.4)::INT)")} AS lift FROM scored""",
)
def _(r):
    g = risk.scored_v1(r).select((F.round("risk_score", 9) > 0.4).alias("flagged"), (F.col("dong") % 25).isin(3, 8, 12, 17, 21).alias("case"))
    return validate.lift(g, "flagged", "case")


@query(
    "vl5_capture_at",
    f"""WITH t AS (SELECT i, j, percent_rank() OVER (ORDER BY {_S}) >= 0.8 AS top FROM scored),
        z AS (SELECT DISTINCT x // 100 AS i, y // 100 AS j FROM site)
        SELECT count(*) AS cases, {R('avg(t.top::INT)')} AS captured FROM t JOIN z ON z.i = t.i AND z.j = t.j""",
)
def _(r):
    traces = spatial.with_cell(r.site).select("i", "j").distinct().withColumn("hit", F.lit(1))
    g = risk.scored_v1(r).withColumn("s", F.round("risk_score", 9)).join(traces, ["i", "j"], "left")
    return validate.capture_at(g, "s", "grid_id", "hit")


def _spearman_sql(a: str, b: str, source: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"SELECT count(*) AS n, {R('corr(ra, rb)')} AS rho FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("vl6_spearman", _spearman_sql("l_quantity", "l_partkey", "lineitem"))
def _(r):
    return validate.spearman(r.table("lineitem"), "l_quantity", "l_partkey")


@query(
    "vl6_spearman_districts",
    "WITH d AS (SELECT dong, round(avg(risk_score), 9) AS s, sum(complaints) AS n FROM scored GROUP BY 1) " + _spearman_sql("s", "n", "d"),
)
def _(r):
    d = risk.scored_v1(r).groupBy("dong").agg(F.round(F.avg("risk_score"), 9).alias("s"), F.sum("complaints").alias("n"))
    return validate.spearman(d, "s", "n")


@query(
    "vl7_kappa",
    f"""WITH l AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT avg((a = b)::INT) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe, count(*) AS n FROM l)
        SELECT n, {R('po')} AS agreement, {R('(po - pe) / (1 - pe)')} AS kappa FROM t""",
)
def _(r):
    return validate.kappa(r.table("labels"), "quality", "toxic")


@query(
    "vl7_kappa_grades",
    f"""WITH g AS (SELECT {risk.grade_fixed_sql('risk_score')} AS a, {risk.grade_fixed_sql('flood_score')} AS b FROM scored),
        u AS (SELECT a, b FROM g WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT count(*) * 1.0 AS n, sum((a = b)::INT) AS same FROM u),
        x AS (SELECT a AS label, count(*) AS na FROM u GROUP BY 1), y AS (SELECT b AS label, count(*) AS nb FROM u GROUP BY 1),
        e AS (SELECT sum(na * nb) AS cross_sum FROM x JOIN y ON x.label = y.label)
        SELECT CAST(n AS BIGINT) AS n, {R('same / n')} AS agreement, {R('(same / n - cross_sum / (n * n)) / (1 - cross_sum / (n * n))')} AS kappa FROM m CROSS JOIN e""",
)
def _(r):
    from rillgrid.functions.scores import grade_fixed

    g = risk.scored_v1(r).select("risk_grade", grade_fixed(F.col("flood_score")).alias("flood_grade"))
    return validate.kappa(g, "risk_grade", "flood_grade")


@query(
    "vl8_accuracy",
    f"""SELECT count(*) AS n, {R("avg((t = CASE WHEN source IN ('src1', 'src2') THEN 'odour' ELSE '기타' END)::INT)")} AS accuracy
        FROM (SELECT source, {_match('text')} AS t FROM documents)""",
)
def _(r):
    d = r.table("documents").select(
        classify_keyword("text", PATTERNS).alias("t"), F.when(F.col("source").isin("src1", "src2"), "odour").otherwise("기타").alias("truth")
    )
    return validate.accuracy(d, "t", "truth")


@query(
    "vl9_stratified_sample",
    """SELECT lang, doc_id, CAST(rn AS INTEGER) AS rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
       WHERE rn <= 25""",
)
def _(r):
    return validate.stratified_sample(r.table("documents").select("lang", "doc_id"), "lang", "doc_id", 25)


@query(
    "vl10_median_percentile",
    f"""WITH p AS (SELECT i, j, percent_rank() OVER (ORDER BY {_S}) * 100 AS pct FROM scored), z AS (SELECT DISTINCT x // 100 AS i, y // 100 AS j FROM site)
        SELECT {R('quantile_cont(pct, 0.5)')} AS median_percentile FROM p JOIN z ON z.i = p.i AND z.j = p.j""",
)
def _(r):
    from rillgrid.functions.geo import cell_id

    zone = spatial.with_cell(r.site).select(cell_id("i", "j").alias("grid_id"))
    return validate.median_percentile(risk.scored_v1(r).withColumn("s", F.round("risk_score", 9)), "s", "grid_id", zone)


@query(
    "vl12_temporal_split",
    f"""WITH b AS (SELECT dong, approval_year AS yr, basement::INT AS y FROM building), t AS (SELECT dong, avg(y) AS rate FROM b WHERE yr < 2000 GROUP BY 1),
        l AS (SELECT y, round(coalesce(rate, 0), 9) AS s FROM b LEFT JOIN t ON t.dong = b.dong WHERE yr >= 2000),
        k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM l)
        SELECT {R('(sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))')} AS auc,
        count(*) FILTER (WHERE y = 1) AS positives, count(*) AS n FROM k""",
)
def _(r):
    b = r.building.select("dong", "approval_year", F.col("basement").cast("int").alias("y"))
    return validate.temporal_split_auc(b, "approval_year", 2000, "dong", "y")


@query(
    "vl13_zone_overlap",
    f"""WITH f AS (SELECT DISTINCT x // 100 AS i, y // 100 AS j FROM complaint WHERE mm >= 25), o AS (SELECT DISTINCT x // 100 AS i, y // 100 AS j FROM household)
        SELECT count(*) AS union_cells, count(*) FILTER (WHERE f.i IS NOT NULL AND o.i IS NOT NULL) AS shared_cells,
        {R('count(*) FILTER (WHERE f.i IS NOT NULL AND o.i IS NOT NULL) * 1.0 / count(*)')} AS iou FROM f FULL OUTER JOIN o ON f.i = o.i AND f.j = o.j""",
)
def _(r):
    return validate.zone_overlap(spatial.with_cell(r.complaint.where("mm >= 25")), spatial.with_cell(r.household))


_PARTS = ["flood_score", "sewer_score", "vuln_score"]


def _weighted_sql(w) -> str:
    return f"round({w[0]} * flood_score + {w[1]} * sewer_score + {w[2]} * vuln_score, 9)"


@query(
    "sn1_weight_sensitivity",
    "WITH t AS (" + " UNION ALL ".join(
        f"(SELECT '{label}' AS label, grid_id FROM scored ORDER BY {_weighted_sql(w)} DESC, grid_id LIMIT 20)" for label, *w in validate.WEIGHT_SETS
    ) + f") SELECT t.label, {R('count(b.grid_id) / 20.0 * 100')} AS overlap_pct FROM t LEFT JOIN (SELECT grid_id FROM t WHERE label = '기본') b ON b.grid_id = t.grid_id GROUP BY 1",
)
def _(r):
    return validate.weight_sensitivity(risk.scored_v1(r), _PARTS, "grid_id")


@query(
    "sn2_drop_variable",
    "WITH d AS (SELECT round(risk_score, 9) AS a, round(0.4 * sewer_score + 0.6 * vuln_score, 9) AS b FROM scored) " + _spearman_sql("a", "b", "d"),
)
def _(r):
    g = risk.scored_v1(r).select(
        F.round("risk_score", 9).alias("a"), F.round(index.weighted_sum({"sewer_score": 0.4, "vuln_score": 0.6}), 9).alias("b")
    )
    return validate.drop_variable(g, "a", "b")


def _scenario_sql() -> str:
    parts = []
    for label, *w in validate.WEIGHT_SETS[:3]:
        for norm in ("a", "b"):
            cols = [f"{norm}{k}" for k in range(3)]
            parts.append(f"SELECT grid_id, '{label}|{norm}|sum' AS sc, round(" + " + ".join(f"{x} * {c}" for x, c in zip(w, cols)) + ", 9) AS s FROM n")
            parts.append(f"SELECT grid_id, '{label}|{norm}|product' AS sc, round(" + " * ".join(f"pow({c} + 0.05, {x})" for x, c in zip(w, cols)) + ", 9) AS s FROM n")
    norms = ", ".join(f"{risk.mm_sql(c, 'scored')} AS a{k}, {c} / (SELECT max({c}) FROM scored) AS b{k}" for k, c in enumerate(_PARTS))
    return f"""WITH n AS MATERIALIZED (SELECT grid_id, {norms} FROM scored), l AS ({' UNION ALL '.join(parts)}),
        k AS (SELECT grid_id, rank() OVER (PARTITION BY sc ORDER BY s DESC) AS rk FROM l)
        SELECT grid_id, {R('quantile_cont(rk, 0.5)')} AS median_rank, min(rk) AS best_rank, max(rk) AS worst_rank FROM k GROUP BY 1"""


@query("sn3_rank_scenarios", _scenario_sql())
def _(r):
    return validate.rank_scenarios(risk.scored_v1(r), _PARTS, "grid_id")


@query(
    "sn4_unit_effect",
    """WITH f AS (SELECT dong, round(avg(risk_score), 9) AS fine FROM scored GROUP BY 1),
       b AS (SELECT i // 5 AS bi, j // 5 AS bj, max(risk_score) AS m, arg_min(dong, i * 1000000 + j) AS dong FROM scored GROUP BY 1, 2),
       c AS (SELECT dong, round(avg(m), 9) AS coarse FROM b GROUP BY 1), d AS (SELECT fine, coarse FROM f JOIN c ON c.dong = f.dong) """
    + _spearman_sql("fine", "coarse", "d"),
)
def _(r):
    return validate.unit_effect(risk.scored_v1(r), "risk_score", "dong")


@query(
    "sn4_coarse_top20_overlap",
    f"""WITH a AS (SELECT DISTINCT i // 5 AS bi, j // 5 AS bj FROM (SELECT i, j FROM scored ORDER BY {_S} DESC, grid_id LIMIT 20)),
        b AS (SELECT bi, bj FROM (SELECT i // 5 AS bi, j // 5 AS bj, round(max(risk_score), 9) AS m FROM scored GROUP BY 1, 2) ORDER BY m DESC, concat(bi, '_', bj) LIMIT 20)
        SELECT count(*) AS shared, {R('count(*) / 20.0 * 100')} AS overlap_pct FROM a JOIN b USING (bi, bj)""",
)
def _(r):
    from rillgrid.operators.aggregates import coarsen

    g = risk.scored_v1(r)
    fine = topk.top_n(g.withColumn("s", F.round("risk_score", 9)), "s", "grid_id").select(
        F.concat_ws("_", F.floor(F.col("i") / 5).cast("string"), F.floor(F.col("j") / 5).cast("string")).alias("block")
    )
    blocks = coarsen(g, "risk_score").select(F.concat_ws("_", F.col("bi").cast("string"), F.col("bj").cast("string")).alias("block"), F.round("max_score", 9).alias("m"))
    return topk.set_overlap(fine, topk.top_n(blocks, "m", "block"), "block")


@query(
    "sn5_grade_shift",
    f"SELECT {risk.grade_fixed_sql(_weighted_sql((0.4, 0.35, 0.25)))} AS a, {risk.grade_fixed_sql(_weighted_sql((0.3, 0.3, 0.4)))} AS b, count(*) AS n FROM scored GROUP BY 1, 2",
)
def _(r):
    from rillgrid.functions.scores import grade_fixed

    w = lambda *x: grade_fixed(F.round(index.weighted_sum(dict(zip(_PARTS, x))), 9))
    return validate.grade_shift(risk.scored_v1(r).select(w(0.4, 0.35, 0.25).alias("x"), w(0.3, 0.3, 0.4).alias("y")), "x", "y")


def _weight_sets_sql() -> str:
    from rillgrid.plans.indexes_queries import _ANSWERS, _entropy

    scaled = f"SELECT grid_id, 0.05 + 0.95 * {risk.mm_sql('h', 'std_p')} AS a, e AS b, 0.05 + 0.95 * {risk.mm_sql('v', 'std_p')} AS c FROM std_p"
    entropy = " UNION ALL ".join(f"SELECT {k} AS i, 1 - {_entropy(c)} AS g FROM (SELECT 1)" for k, c in enumerate(("h", "e", "v"), 1))
    return f"""WITH {_ANSWERS}, ent AS (SELECT i, g / sum(g) OVER () AS w FROM ({entropy})),
        sets AS (SELECT 'equal' AS label, 1 / 3.0::DOUBLE AS w1, 1 / 3.0::DOUBLE AS w2, 1 / 3.0::DOUBLE AS w3
          UNION ALL SELECT 'entropy', max(w) FILTER (i = 1), max(w) FILTER (i = 2), max(w) FILTER (i = 3) FROM ent
          UNION ALL SELECT 'ahp', max(w) FILTER (i = 1), max(w) FILTER (i = 2), max(w) FILTER (i = 3) FROM w),
        p AS MATERIALIZED (SELECT label, grid_id, pow(a, w1) * pow(b, w2) * pow(c, w3) AS p FROM ({scaled}) CROSS JOIN sets),
        s AS MATERIALIZED (SELECT label, grid_id, round((p - min(p) OVER m) / (max(p) OVER m - min(p) OVER m), 9) AS s FROM p WINDOW m AS (PARTITION BY label)),
        k AS MATERIALIZED (SELECT label, grid_id, rank() OVER (PARTITION BY label ORDER BY s) + (count(*) OVER (PARTITION BY label, s) - 1) / 2.0 AS rk,
          row_number() OVER (PARTITION BY label ORDER BY s DESC, grid_id) AS pos FROM s)
        SELECT o.label, count(*) AS cells, {R('corr(b.rk, o.rk)')} AS rho, count(*) FILTER (b.pos <= 20 AND o.pos <= 20) AS shared
        FROM k b JOIN k o ON o.grid_id = b.grid_id WHERE b.label = 'equal' AND o.label <> 'equal' GROUP BY 1"""


def _weight_sets(r, g):
    """Equal, entropy and pairwise weights of hazard, exposure and vulnerability."""
    from rillgrid.plans.indexes_queries import ahp_answers

    entropy = {x["var"]: x["w"] for x in index.entropy_weights(g, ["h", "e", "v"]).collect()}
    ahp = {x["item"]: x["w"] for x in index.ahp_weights(ahp_answers(r)).collect()}
    return {"equal": (1 / 3,) * 3, "entropy": [entropy[c] for c in "hev"], "ahp": [ahp[k] for k in (1, 2, 3)]}


@query("sn6_cdri_weight_sets", _weight_sets_sql())
def _(r):
    g = risk.scored_std(r)
    return validate.index_weight_sets(g.select("grid_id", "h", "e", "v"), "grid_id", _weight_sets(r, g))


@query(
    "vl7_kappa_index_breaks",
    f"""WITH {{cuts}}, g AS (SELECT CASE WHEN cdri < 0.01 THEN 1 WHEN cdri < 0.25 THEN 2 WHEN cdri < 0.5 THEN 3 WHEN cdri < 0.75 THEN 4 ELSE 5 END AS a,
          1 + (SELECT count(*) FROM c_cuts WHERE cdri > top) AS b FROM ranked),
        m AS (SELECT count(*) * 1.0 AS n, sum((a = b)::INT) AS same FROM g), x AS (SELECT a AS label, count(*) AS na FROM g GROUP BY 1), y AS (SELECT b AS label, count(*) AS nb FROM g GROUP BY 1),
        e AS (SELECT sum(na * nb) AS cross_sum FROM x JOIN y ON x.label = y.label)
        SELECT CAST(n AS BIGINT) AS n, {R('same / n')} AS agreement, {R('(same / n - cross_sum / (n * n)) / (1 - cross_sum / (n * n))')} AS kappa FROM m CROSS JOIN e""".replace(
        "{cuts}", "ranked AS MATERIALIZED (SELECT cdri FROM std WHERE cdri IS NOT NULL), " + jenks_sql("c", "ranked", "cdri", 5)
    ),
)
def _(r):
    """Published bounds of the index grades against five natural classes."""
    from rillgrid.functions.scores import INDEX_GRADES, class_code

    g = risk.scored_std(r).where("cdri IS NOT NULL").select("cdri", "grade")
    place = F.array_position(F.array(*[F.lit(x) for x in INDEX_GRADES]), F.col("grade")).cast("int")
    return validate.kappa(g.select(place.alias("a"), class_code("cdri", jenks_breaks(g, "cdri", 5)).alias("b")), "a", "b")


# Measures of the acceptance table and their limits; a null limit is reported only.
ACCEPTANCE = (
    ("layer 1", "auc of complaints", 0.65, "least"),
    ("layer 2", "rho of rules without complaints", 0.4, "least"),
    ("layer 3", "largest variance inflation", 5.0, "below"),
    ("index", "least rho of weight sets", 0.9, "least"),
    ("index", "least shared top 20", 14.0, "least"),
    ("index", "rho of merged cells", 0.8, "least"),
    ("index", "kappa of grade bounds", None, "reported"),
)


def _acceptance_sql() -> str:
    from rillgrid.plans.registry import SQL

    a, b, c = risk.PEOPLE
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    rules = f"pow(({risk.mm_sql('combined_share', 'std_t')} + 0.05) * ({risk.mm_sql('pipe_density', 'std_t')} + 0.05), 0.5::DOUBLE)"
    values = (
        f"""(SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) FROM (SELECT y, {rank('s')} AS rk FROM (SELECT round(l1, 9) AS s, (complaints > 0)::INT AS y FROM std)))""",
        f"""(SELECT corr(ra, rb) FROM (SELECT {rank('round(l2, 9)')} AS ra, {rank('complaints')} AS rb FROM (SELECT (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) AS l2, complaints
            FROM (SELECT {rules} AS g, complaints FROM std_t) WHERE g IS NOT NULL)))""",
        f"""(SELECT greatest(1 - r23 * r23, 1 - r13 * r13, 1 - r12 * r12) / (1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23)
            FROM (SELECT corr({a}, {b}) AS r12, corr({a}, {c}) AS r13, corr({b}, {c}) AS r23 FROM std))""",
        f"(SELECT min(rho) FROM ({SQL['sn6_cdri_weight_sets']}))", f"(SELECT min(shared) FROM ({SQL['sn6_cdri_weight_sets']}))",
        f"(SELECT rho FROM ({SQL['sn4_unit_effect']}))", f"(SELECT kappa FROM ({SQL['vl7_kappa_index_breaks']}))",
    )
    rows = []
    for (stage, measure, limit, how), value in zip(ACCEPTANCE, values):
        test = {"least": f"v >= {limit}", "below": f"v < {limit}", "reported": "CAST(NULL AS BOOLEAN)"}[how]
        rows.append(f"SELECT '{stage}' AS stage, '{measure}' AS measure, {R('v')} AS value, {'NULL' if limit is None else limit}::DOUBLE AS bound, {test} AS passed FROM (SELECT {value} AS v)")
    return " UNION ALL ".join(rows)


@query("vl14_acceptance", _acceptance_sql())
def _(r):
    """One row per measure of the acceptance table, with its limit and whether it is met."""
    from rillgrid.functions.scores import INDEX_GRADES, class_code
    from rillgrid.operators.aggregates import vif

    g = risk.scored_std(r)
    index_cells = g.where("cdri IS NOT NULL").select("cdri", "grade")
    place = F.array_position(F.array(*[F.lit(x) for x in INDEX_GRADES]), F.col("grade")).cast("int")
    graded = index_cells.select(place.alias("a"), class_code("cdri", jenks_breaks(index_cells, "cdri", 5)).alias("b"))
    rules = index.layer2_rules(g.where("treated").select("grid_id", "combined_share", "pipe_density", "complaints"), ["combined_share", "pipe_density"])
    sets = validate.index_weight_sets(g.select("grid_id", "h", "e", "v"), "grid_id", _weight_sets(r, g)).agg(F.min("rho").alias("rho"), F.min("shared").alias("shared")).first()
    found = (
        validate.roc_auc(g.select((F.col("complaints") > 0).cast("int").alias("y"), F.round("l1", 9).alias("s")), "y", "s").first()["auc"],
        validate.spearman(rules.where("l2 IS NOT NULL").select(F.round("l2", 9).alias("a"), "complaints"), "a", "complaints").first()["rho"],
        vif(g, list(risk.PEOPLE)).agg(F.max("vif")).first()[0],
        sets["rho"], sets["shared"],
        validate.unit_effect(risk.scored_v1(r), "risk_score", "dong").first()["rho"],
        validate.kappa(graded, "a", "b").first()["kappa"],
    )
    rows = []
    for (stage, measure, limit, how), value in zip(ACCEPTANCE, found):
        passed = None if how == "reported" or value is None else value >= limit if how == "least" else value < limit
        rows.append((stage, measure, None if value is None else float(value), limit, passed))
    return r.spark.createDataFrame(rows, "stage string, measure string, value double, bound double, passed boolean")
