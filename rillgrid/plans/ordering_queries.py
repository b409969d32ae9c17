"""Ranks, focal windows, top lists and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillgrid.operators import rain, terrain, topk
from rillgrid.operators.ordering import quantiles, with_ranks
from rillgrid.plans.registry import R, query
from rillgrid.plans.risk import grade_fixed_sql, scored_v1

_S = "round(risk_score, 9)"


def _scored(r):
    return scored_v1(r).withColumn("s", F.round("risk_score", 9))


@query(
    "wn4_percent_rank",
    f"""SELECT grid_id, {R('percent_rank() OVER (ORDER BY round(flood_score, 9))')} AS flood_pct, {R('percent_rank() OVER (ORDER BY round(sewer_score, 9))')} AS sewer_pct FROM scored""",
)
def _(r):
    s = scored_v1(r).select("grid_id", F.round("flood_score", 9).alias("f"), F.round("sewer_score", 9).alias("w"))
    s = with_ranks(with_ranks(s, "f", ["grid_id"], prefix="flood_"), "w", ["grid_id"], prefix="sewer_")
    return s.select("grid_id", F.col("flood_pct_rank").alias("flood_pct"), F.col("sewer_pct_rank").alias("sewer_pct"))


@query(
    "wn4_percent_rank_rows",
    f"""WITH p AS (SELECT o_orderkey, percent_rank() OVER (ORDER BY o_totalprice) AS pct FROM orders)
        SELECT o_orderkey, {R('pct')} AS pct FROM p""",
)
def _(r):
    """Every order, cut into value ranges as a large table would be."""
    return with_ranks(r.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).select(
        "o_orderkey", F.col("pct_rank").alias("pct")
    )


@query(
    "wn5_rank_avg",
    f"""SELECT doc_id, {R('rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0')} AS rank_avg FROM documents""",
)
def _(r):
    return with_ranks(r.table("documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"]).select("doc_id", "rank_avg")


@query(
    "wn6_focal_mean",
    f"""WITH f AS (SELECT d.row, d.col, d.z, sum(o.z) / count(o.z) AS focal FROM dem d CROSS JOIN (SELECT unnest(range(-5, 6)) AS dr) a CROSS JOIN (SELECT unnest(range(-5, 6)) AS dc) b
        JOIN dem o ON o.row = d.row + a.dr AND o.col = d.col + b.dc GROUP BY 1, 2, 3)
        SELECT row, col, {R('focal')} AS focal FROM f""",
)
def _(r):
    return terrain.focal_mean(r.dem, 5).select("row", "col", "focal")


@query(
    "wn7_hot_spots",
    f"""WITH g AS (SELECT count(*) * 1.0 AS n, avg(pipe_length) AS m, stddev_pop(pipe_length) AS s FROM features WHERE pipe_length IS NOT NULL),
        c AS (SELECT i, j, pipe_length AS v FROM features WHERE pipe_length IS NOT NULL),
        a AS (SELECT c.i, c.j, sum(o.v) AS t, count(*) * 1.0 AS k FROM c JOIN c o ON o.i BETWEEN c.i - 1 AND c.i + 1 AND o.j BETWEEN c.j - 1 AND c.j + 1 GROUP BY 1, 2)
        SELECT i, j, {R('(t - m * k) / (s * sqrt((n * k - k * k) / (n - 1)))')} AS gi FROM a CROSS JOIN g""",
)
def _(r):
    from rillgrid.operators.spatial import with_cell

    cells = with_cell(r.pipe).groupBy("i", "j").agg(F.sum("length").alias("v"))
    return terrain.hot_spots(cells, "v")


@query(
    "wn8_latest_snapshot",
    f"""SELECT o_custkey, o_orderkey, {R('o_totalprice')} AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1""",
)
def _(r):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    latest = r.table("orders").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return latest.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "tk1_priority_top20",
    f"""SELECT grid_id, {R('flood_score')} AS flood_score, {R('sewer_score')} AS sewer_score, {R('vuln_score')} AS vuln_score, {R('risk_score')} AS risk_score,
        {grade_fixed_sql('risk_score')} AS risk_grade FROM scored ORDER BY {_S} DESC, grid_id LIMIT 20""",
)
def _(r):
    """Flagship: role views, grid, cell layers, three scores, weighted index, grade, first 20."""
    return topk.top_n(_scored(r), "s", "grid_id").select("grid_id", "flood_score", "sewer_score", "vuln_score", "risk_score", "risk_grade")


def spaced(r, n=20):
    cells = _scored(r).select("grid_id", (F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"), "s")
    return topk.top_n_spaced(cells, "s", "grid_id", n, 300.0)


# Greedy suppression as a recursion over ranks: a cell is kept when no kept cell before it is near.
SPACED_SQL = f"""WITH RECURSIVE c AS (SELECT grid_id, i, j, {_S} AS s, row_number() OVER (ORDER BY {_S} DESC, grid_id) AS rn FROM scored),
  walk AS (SELECT 0::BIGINT AS rn, []::STRUCT(i BIGINT, j BIGINT, g VARCHAR)[] AS kept UNION ALL
    SELECT c.rn, CASE WHEN len(list_filter(kept, lambda k: pow(k.i - c.i, 2) + pow(k.j - c.j, 2) <= 9)) = 0
      THEN list_append(kept, {{'i': c.i, 'j': c.j, 'g': c.grid_id}}) ELSE kept END FROM walk JOIN c ON c.rn = walk.rn + 1 WHERE len(kept) < 20),
  picks AS (SELECT unnest(kept).g AS grid_id FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1))"""


@query("tk2_spaced_top20", SPACED_SQL + f" SELECT grid_id, {R('s')} AS s FROM c JOIN picks USING (grid_id)")
def _(r):
    return spaced(r).select("grid_id", "s")


@query("tk2_suppress_neighbours", SPACED_SQL.replace("WHERE len(kept) < 20", "") + f" SELECT grid_id, {R('s')} AS s FROM c JOIN picks USING (grid_id)")
def _(r):
    """Suppression over the whole grid."""
    cells = _scored(r).select("grid_id", (F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"), "s")
    return topk.suppress_neighbours(cells, "s", "grid_id", 300.0).select("grid_id", "s")


@query(
    "tk3_top_share",
    f"SELECT grid_id, percent_rank() OVER (ORDER BY {_S}) >= 0.8 AS in_top FROM scored",
)
def _(r):
    return topk.top_share(_scored(r), "s", "grid_id", 0.2).select("grid_id", "in_top")


@query(
    "so1_concat",
    "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS extra FROM nation UNION ALL SELECT s_name, NULL FROM supplier",
)
def _(r):
    a = r.table("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("extra"))
    return rain.merge_networks(a, r.table("supplier").select(F.col("s_name").alias("name")))


@query(
    "so2_topset_overlap",
    f"""WITH a AS (SELECT grid_id FROM scored ORDER BY {_S} DESC, grid_id LIMIT 20), b AS (SELECT grid_id FROM scored ORDER BY round(flood_score, 9) DESC, grid_id LIMIT 20)
        SELECT count(*) AS shared, {R('count(*) / 20.0 * 100')} AS overlap_pct FROM (SELECT grid_id FROM a INTERSECT SELECT grid_id FROM b)""",
)
def _(r):
    s = _scored(r).withColumn("f", F.round("flood_score", 9))
    return topk.set_overlap(topk.top_n(s, "s", "grid_id"), topk.top_n(s, "f", "grid_id"), "grid_id")


@query(
    "so3_undesignated",
    f"""WITH t AS (SELECT grid_id, i, j FROM scored ORDER BY {_S} DESC, grid_id LIMIT 50)
        SELECT grid_id FROM t WHERE NOT EXISTS (SELECT 1 FROM site s WHERE s.x // 400 = t.i // 4 AND s.y // 400 = t.j // 4)""",
)
def _(r):
    known = r.site.select(F.floor(F.col("x") / 400).alias("zi"), F.floor(F.col("y") / 400).alias("zj")).distinct()
    high = topk.top_n(_scored(r), "s", "grid_id", 50).select("grid_id", F.floor(F.col("i") / 4).alias("zi"), F.floor(F.col("j") / 4).alias("zj"))
    return high.join(known, ["zi", "zj"], "left_anti").select("grid_id")


@query(
    "wn_grouped_quantiles",
    f"""SELECT l_returnflag, 'l_extendedprice' AS var, p.p AS p, {R('CASE WHEN p.p = 0.25 THEN q1 ELSE q3 END')} AS q FROM (SELECT l_returnflag,
        quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
        CROSS JOIN (SELECT CAST(unnest([0.25, 0.75]) AS DOUBLE) AS p) p""",
)
def _(r):
    return quantiles(r.table("lineitem"), ["l_extendedprice"], [0.25, 0.75], by=["l_returnflag"])
