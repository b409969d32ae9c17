"""Terrain on the pixel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.operators import terrain
from rillgrid.plans.registry import R, query
from rillgrid.staging import settle

TILE = 64

_SLOPE = """SELECT row, col, sqrt(gx * gx + gy * gy) AS tan_slope FROM (SELECT row, col,
  (coalesce(e, z) - coalesce(w, z)) / CASE WHEN e IS NOT NULL AND w IS NOT NULL THEN 20.0 ELSE 10.0 END AS gx,
  (coalesce(s, z) - coalesce(n, z)) / CASE WHEN s IS NOT NULL AND n IS NOT NULL THEN 20.0 ELSE 10.0 END AS gy FROM (
    SELECT d.row, d.col, d.z, w.z AS w, e.z AS e, n.z AS n, s.z AS s FROM dem d
    LEFT JOIN dem w ON w.row = d.row AND w.col = d.col - 1 LEFT JOIN dem e ON e.row = d.row AND e.col = d.col + 1
    LEFT JOIN dem n ON n.row = d.row - 1 AND n.col = d.col LEFT JOIN dem s ON s.row = d.row + 1 AND s.col = d.col))"""


def _down(table: str) -> str:
    """Steepest descending neighbour of each pixel."""
    return f"""SELECT row, col, nr, nc FROM (SELECT d.row, d.col, o.row AS nr, o.col AS nc, row_number() OVER (PARTITION BY d.row, d.col
        ORDER BY (d.z - o.z) / CASE WHEN o.row <> d.row AND o.col <> d.col THEN sqrt(2.0) ELSE 1.0 END DESC, o.row, o.col) AS rn
        FROM {table} d JOIN (SELECT unnest(range(-1, 2)) AS dr) a ON true JOIN (SELECT unnest(range(-1, 2)) AS dc) b ON true
        JOIN {table} o ON o.row = d.row + a.dr AND o.col = d.col + b.dc WHERE d.z > o.z) WHERE rn = 1"""


def _upstream(table: str) -> str:
    return f"""down AS MATERIALIZED ({_down(table)}),
      walk AS (SELECT row, col, row AS ar, col AS ac FROM {table} UNION ALL
        SELECT w.row, w.col, d.nr, d.nc FROM walk w JOIN down d ON d.row = w.ar AND d.col = w.ac),
      up AS MATERIALIZED (SELECT ar AS row, ac AS col, count(*) AS upstream FROM walk GROUP BY 1, 2)"""


@query("tr1_slope", f"WITH s AS ({_SLOPE}) SELECT col // 3 AS i, row // 3 AS j, {R('avg(degrees(atan(tan_slope)))')} AS slope FROM s GROUP BY 1, 2")
def _(r):
    return terrain.zonal_mean(terrain.slope_degrees(r.dem, 10.0, TILE), "slope", 3, "slope")


@query(
    "tr2_relative_elevation",
    f"""WITH f AS (SELECT d.row, d.col, d.z, sum(o.z) / count(o.z) AS focal FROM rough_dem d CROSS JOIN (SELECT unnest(range(-5, 6)) AS dr) a CROSS JOIN (SELECT unnest(range(-5, 6)) AS dc) b
        JOIN rough_dem o ON o.row = d.row + a.dr AND o.col = d.col + b.dc GROUP BY 1, 2, 3)
        SELECT col // 3 AS i, row // 3 AS j, {R('avg(z) - avg(focal)')} AS relative FROM f GROUP BY 1, 2""",
)
def _(r):
    return terrain.relative_elevation(r.rough_dem, 5, 3, TILE)


# A pixel is filled to the lowest level at which pixels not above that level lead to the border.
_FILLED = """WITH RECURSIVE around AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dr, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dc),
  edge AS MATERIALIZED (SELECT d.row, d.col FROM rough_dem d CROSS JOIN around a LEFT JOIN rough_dem o ON o.row = d.row + a.dr AND o.col = d.col + a.dc
    GROUP BY 1, 2 HAVING count(o.row) < 8),
  levels AS (SELECT DISTINCT z AS level FROM rough_dem),
  reach AS (SELECT l.level, d.row, d.col FROM levels l JOIN rough_dem d ON d.z <= l.level JOIN edge e ON e.row = d.row AND e.col = d.col
    UNION SELECT r.level, o.row, o.col FROM reach r CROSS JOIN around a JOIN rough_dem o ON o.row = r.row + a.dr AND o.col = r.col + a.dc WHERE o.z <= r.level)"""


@query("tr3_fill_sinks", f"{_FILLED} SELECT d.row, d.col, d.z, min(r.level) AS filled FROM rough_dem d JOIN reach r ON r.row = d.row AND r.col = d.col GROUP BY 1, 2, 3")
def _(r):
    return terrain.fill_sinks(r.rough_dem, TILE)


@query("tr4_flow_direction", f"SELECT row, col, nr AS down_row, nc AS down_col FROM ({_down('rough_dem')})")
def _(r):
    return terrain.flow_direction(r.rough_dem, tile=TILE).where("down_row is not null").select("row", "col", "down_row", "down_col")


@query("tr5_flow_accumulation", f"WITH RECURSIVE {_upstream('dem')} SELECT row, col, upstream FROM up")
def _(r):
    flow = terrain.flow_direction(r.dem, tile=TILE)
    up = terrain.flow_accumulation(flow)
    return flow.join(up.hint("merge"), "id").select("row", "col", "upstream")


@query("tr5_flow_accumulation_rough", f"WITH RECURSIVE {_upstream('rough_dem')} SELECT row, col, upstream FROM up")
def _(r):
    flow = terrain.flow_direction(r.rough_dem, tile=TILE)
    return flow.join(terrain.flow_accumulation(flow).hint("merge"), "id").select("row", "col", "upstream")


@query(
    "tr6_wetness",
    f"""WITH RECURSIVE {_upstream('dem')}, s AS ({_SLOPE}) SELECT s.row, s.col, {R('ln(upstream * 100.0 / greatest(tan_slope, 0.001))')} AS twi
        FROM s JOIN up ON up.row = s.row AND up.col = s.col""",
)
def _(r):
    return terrain.wetness(r.dem, 10.0, tile=TILE).select("row", "col", "twi")


@query(
    "tr7_height_above_channel",
    f"""WITH RECURSIVE {_upstream('dem')}, ch AS MATERIALIZED (SELECT row, col FROM up WHERE upstream >= 30),
      path AS (SELECT d.row, d.col, d.row AS ar, d.col AS ac FROM dem d UNION ALL
        SELECT p.row, p.col, n.nr, n.nc FROM path p JOIN down n ON n.row = p.ar AND n.col = p.ac
        LEFT JOIN ch ON ch.row = p.ar AND ch.col = p.ac WHERE ch.row IS NULL)
      SELECT d.row, d.col, {R('d.z - b.z')} AS hand FROM dem d LEFT JOIN (SELECT p.row, p.col, o.z FROM path p JOIN ch ON ch.row = p.ar AND ch.col = p.ac
        JOIN dem o ON o.row = p.ar AND o.col = p.ac) b ON b.row = d.row AND b.col = d.col""",
)
def _(r):
    return terrain.height_above_channel(r.dem, 30, TILE)


# The filled surface: flat pixels go to the nearest outlet over pixels of their height.
_LAKES = f"""{_FILLED}, surf AS MATERIALIZED (SELECT row, col, min(level) AS z FROM reach GROUP BY 1, 2),
  steep AS MATERIALIZED ({_down("surf")}),
  flat AS MATERIALIZED (SELECT s.row, s.col, s.z FROM surf s ANTI JOIN steep d ON d.row = s.row AND d.col = s.col ANTI JOIN edge e ON e.row = s.row AND e.col = s.col),
  beside AS MATERIALIZED (SELECT f.row, f.col, o.row AS nr, o.col AS nc, t.row IS NULL AS out FROM flat f CROSS JOIN around a
    JOIN surf o ON o.row = f.row + a.dr AND o.col = f.col + a.dc AND o.z = f.z LEFT JOIN flat t ON t.row = o.row AND t.col = o.col),
  way(row, col, d) USING KEY (row, col) AS (SELECT DISTINCT row, col, 1 FROM beside WHERE out
    UNION SELECT DISTINCT b.row, b.col, w.d + 1 FROM way w JOIN beside b ON b.nr = w.row AND b.nc = w.col AND NOT b.out
      LEFT JOIN recurring.way k ON k.row = b.row AND k.col = b.col WHERE k.row IS NULL),
  over AS (SELECT b.row, b.col, w.d, min((b.nr, b.nc)) AS n FROM beside b JOIN way w ON w.row = b.row AND w.col = b.col
    LEFT JOIN way k ON k.row = b.nr AND k.col = b.nc WHERE (w.d = 1 AND b.out) OR (NOT b.out AND k.d = w.d - 1) GROUP BY 1, 2, 3),
  down AS MATERIALIZED (SELECT row, col, nr, nc, 0 AS steps FROM steep UNION ALL SELECT row, col, n[1], n[2], d FROM over)"""
_LAKES_UP = f"""{_LAKES}, walk AS (SELECT row, col, row AS ar, col AS ac FROM surf UNION ALL
    SELECT w.row, w.col, d.nr, d.nc FROM walk w JOIN down d ON d.row = w.ar AND d.col = w.ac),
  up AS MATERIALIZED (SELECT ar AS row, ac AS col, count(*) AS upstream FROM walk GROUP BY 1, 2)"""


def _lakes(r):
    surface = terrain.fill_sinks(r.rough_dem, TILE).select("row", "col", F.col("filled").alias("z"))
    surface = settle(surface, "surface")
    return surface, settle(terrain.flow_over_flats(surface, tile=TILE), "drained")


@query(
    "tr4_flow_over_flats",
    f"""{_LAKES} SELECT s.row, s.col, {R("s.z")} AS z, coalesce(d.nr, -1) AS down_row, coalesce(d.nc, -1) AS down_col, coalesce(d.steps, 0)::BIGINT AS steps
        FROM surf s LEFT JOIN down d ON d.row = s.row AND d.col = s.col""",
)
def _(r):
    """Pixels whose flow leaves the surface have -1 for the next one."""
    return _lakes(r)[1].na.fill(-1, ["down_row", "down_col"]).select("row", "col", "z", "down_row", "down_col", "steps")


@query("tr5_flow_accumulation_filled", f"{_LAKES_UP} SELECT row, col, upstream FROM up")
def _(r):
    flow = _lakes(r)[1]
    return flow.join(terrain.flow_accumulation(flow).hint("merge"), "id").select("row", "col", "upstream")


@query(
    "tr5_drained_share",
    f"""{_LAKES_UP} SELECT (SELECT count(*) FROM rough_dem) AS pixels, (SELECT sum(upstream)::BIGINT FROM up JOIN edge USING (row, col) ANTI JOIN down USING (row, col)) AS drained,
        (SELECT count(*) FROM surf ANTI JOIN edge USING (row, col) ANTI JOIN down USING (row, col)) AS stuck""",
)
def _(r):
    """All pixels arrive at the border: what its end pixels gather is the number of pixels, and no other pixel is an end."""
    flow = _lakes(r)[1]
    ends = flow.join(terrain.flow_accumulation(flow).hint("merge"), "id")
    last = F.col("ptr").isNull()
    return ends.agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.when(last & F.col("border"), F.col("upstream"))).alias("drained"), F.count(F.when(last & ~F.col("border"), 1)).alias("stuck"))


@query(
    "tr6_wetness_filled",
    f"""{_LAKES_UP}, s AS ({_SLOPE.replace("FROM dem d", "FROM surf d").replace("JOIN dem ", "JOIN surf ")})
        SELECT s.row, s.col, {R('ln(upstream * 100.0 / greatest(tan_slope, 0.001))')} AS twi FROM s JOIN up ON up.row = s.row AND up.col = s.col""",
)
def _(r):
    surface, flow = _lakes(r)
    return terrain.wetness(surface, 10.0, tile=TILE, flow=flow).select("row", "col", "twi")


@query(
    "tr7_height_above_channel_filled",
    f"""{_LAKES_UP}, ch AS MATERIALIZED (SELECT row, col FROM up WHERE upstream >= 30),
      path AS (SELECT d.row, d.col, d.row AS ar, d.col AS ac FROM surf d UNION ALL
        SELECT p.row, p.col, n.nr, n.nc FROM path p JOIN down n ON n.row = p.ar AND n.col = p.ac
        LEFT JOIN ch ON ch.row = p.ar AND ch.col = p.ac WHERE ch.row IS NULL)
      SELECT d.row, d.col, {R('d.z - b.z')} AS hand FROM surf d LEFT JOIN (SELECT p.row, p.col, o.z FROM path p JOIN ch ON ch.row = p.ar AND ch.col = p.ac
        JOIN surf o ON o.row = p.ar AND o.col = p.ac) b ON b.row = d.row AND b.col = d.col""",
)
def _(r):
    surface, flow = _lakes(r)
    return terrain.height_above_channel(surface, 30, TILE, flow)
