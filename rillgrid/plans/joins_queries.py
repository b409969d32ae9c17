"""Relational, spatial and temporal joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions.geo import cell_index
from rillgrid.functions.text import text_key
from rillgrid.operators import rain, spatial, topk, validate
from rillgrid.plans.registry import R, query
from rillgrid.plans.risk import scored_v1


@query(
    "jn1_point_in_cell",
    f"""SELECT g.grid_id, count(p.c_id) AS n, {R('sum(p.mm)')} AS mm, coalesce(min(p.c_id), -1) AS first_id FROM grid g
        LEFT JOIN complaint p ON p.x // 100 = g.i AND p.y // 100 = g.j GROUP BY 1""",
)
def _(r):
    met = spatial.point_in_cell(r.grid, r.complaint, ["c_id"])
    return met.groupBy("grid_id").agg(F.count("c_id").alias("n"), F.sum("mm").alias("mm"), F.coalesce(F.min("c_id"), F.lit(-1)).alias("first_id"))


@query(
    "jn2_attach_by_grid_id",
    f"""SELECT g.grid_id, {R('a.len')} AS len, coalesce(b.n, 0) AS homes FROM grid g
        LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, sum(length) AS len FROM pipe GROUP BY 1, 2) a ON a.i = g.i AND a.j = g.j
        LEFT JOIN (SELECT x // 100 AS i, y // 100 AS j, count(*) AS n FROM household GROUP BY 1, 2) b ON b.i = g.i AND b.j = g.j""",
)
def _(r):
    length = spatial.with_cell(r.pipe).groupBy("i", "j").agg(F.sum("length").alias("len"))
    homes = spatial.with_cell(r.household).groupBy("i", "j").agg(F.count(F.lit(1)).alias("homes"))
    return spatial.attach(r.grid, length, homes).select("grid_id", "len", F.coalesce("homes", F.lit(0)).alias("homes"))


# A diamond holds the points whose absolute offsets add up to less than its half diagonal.
@query(
    "jn3_point_in_polygon",
    """SELECT d.poly_id, count(*) AS n, CAST(sum(h.hh_id) AS BIGINT) AS id_sum FROM diamond d JOIN household h
       ON abs(h.x + 0.25 - d.x) + abs(h.y + 0.125 - d.y) < d.h GROUP BY 1""",
)
def _(r):
    edges = spatial.ring_edges(r.diamond, "poly_id")
    # a quarter metre off the integer lattice, so that no point lies on an edge
    points = r.household.select("hh_id", (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.125).alias("y"))
    met = spatial.point_in_polygon(points, edges, "poly_id", ["hh_id"])
    return met.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hh_id").alias("id_sum"))


@query(
    "jn4_cell_polygon_overlap",
    f"SELECT poly_id, {R('2.0 * h * h')} AS area FROM diamond",
)
def _(r):
    """The pieces of a polygon add up to its own area."""
    parts = spatial.cell_polygon_overlap(r.diamond, "poly_id")
    return parts.groupBy("poly_id").agg(F.sum("area").alias("area"))


# Between whole metres the height of a diamond inside a cell is linear, so the midpoint rule with
# steps of one metre gives the exact area.
PIECES_SQL = """SELECT poly_id, i, j, sum(greatest(0.0, least(y + h - abs(u + 0.5 - x), j * 100 + 100) - greatest(y - h + abs(u + 0.5 - x), j * 100))) AS area
  FROM (SELECT *, CAST(floor(u / 100.0) AS BIGINT) AS i, unnest(range(CAST(floor((y - h) / 100.0) AS BIGINT), CAST(floor((y + h) / 100.0) AS BIGINT) + 1)) AS j
    FROM (SELECT *, unnest(range(x - h, x + h)) AS u FROM diamond)) GROUP BY 1, 2, 3"""


@query("jn4_cell_polygon_pieces", f"WITH pieces AS ({PIECES_SQL}) SELECT poly_id, i, j, {R('area')} AS area FROM pieces WHERE area > 0")
def _(r):
    return spatial.cell_polygon_overlap(r.diamond, "poly_id")


# An outline with a hole of a third of its size, and a second part beside it.
def _pieces_of(h: str, shift: int) -> str:
    whole = PIECES_SQL.replace("FROM diamond", f"FROM (SELECT poly_id, x + {shift} AS x, y, CAST({h} AS BIGINT) AS h FROM diamond)")
    return f"SELECT poly_id, i, j, area FROM ({whole})"


def _rings_with_holes(r):
    pt = lambda p, k, shift: F.struct((F.col("c.x") + (p["x"] - F.col("c.x")) * k + shift).alias("x"), (F.col("c.y") + (p["y"] - F.col("c.y")) * k).alias("y"))
    centre = F.struct(((F.col("ring")[0]["x"] + F.col("ring")[2]["x"]) / 2).alias("x"), F.col("ring")[0]["y"].alias("y"))
    base = r.diamond.select("poly_id", "ring", centre.alias("c"), (F.col("ring")[0]["x"] - F.col("ring")[2]["x"]).alias("d"))
    ring = lambda k, shift: F.transform("ring", lambda p: pt(p, k, shift))
    third = F.floor(F.col("d") / 6) / (F.col("d") / 2)
    parts = [(ring(F.lit(1.0), 0), False), (F.reverse(ring(third, 0)), True), (ring(third, 700), False)]
    return base.select("poly_id", F.explode(F.array(*[F.struct(p.alias("ring"), F.lit(h).alias("hole")) for p, h in parts])).alias("p")).select("poly_id", "p.ring", "p.hole")


@query(
    "jn4_overlap_with_holes",
    f"""WITH p AS ({PIECES_SQL}), q AS ({_pieces_of("h // 3", 0)}), t AS ({_pieces_of("h // 3", 700)}),
        a AS (SELECT poly_id, i, j, area FROM p WHERE area > 0 UNION ALL SELECT poly_id, i, j, -area FROM q UNION ALL SELECT poly_id, i, j, area FROM t)
        SELECT poly_id, i, j, {R('sum(area)')} AS area FROM a GROUP BY 1, 2, 3 HAVING sum(area) > 0.00001""",
)
def _(r):
    """Cells of polygons with a hole and a second part."""
    return spatial.cell_polygon_overlap(_rings_with_holes(r), "poly_id", hole="hole")


def _centres(r):
    return r.grid.select("grid_id", (F.col("i") * 100 + 50).alias("x"), (F.col("j") * 100 + 50).alias("y"))


_DIST = "sqrt(pow(s.x - (g.i * 100 + 50), 2) + pow(s.y - (g.j * 100 + 50), 2))"


@query(
    "jn5_nearest_site",
    f"""SELECT grid_id, site_id, {R('d')} AS d FROM (SELECT g.grid_id, s.site_id, {_DIST} AS d,
        row_number() OVER (PARTITION BY g.grid_id ORDER BY {_DIST}, s.site_id) AS rn FROM grid g CROSS JOIN site s) WHERE rn = 1""",
)
def _(r):
    return spatial.k_nearest(_centres(r), r.site, "grid_id", "site_id", 1).select("grid_id", "site_id", "d")


@query(
    "jn6_knn_within",
    f"""SELECT grid_id, site_id, CAST(rn AS INTEGER) AS rn, {R('d')} AS d FROM (SELECT g.grid_id, s.site_id, {_DIST} AS d,
        row_number() OVER (PARTITION BY g.grid_id ORDER BY {_DIST}, s.site_id) AS rn FROM grid g CROSS JOIN site s
        WHERE {_DIST} <= 1000) WHERE rn <= 12""",
)
def _(r):
    return spatial.k_nearest(_centres(r), r.site, "grid_id", "site_id", 12, max_radius=1000.0).select("grid_id", "site_id", "rn", "d")


@query(
    "jn7_within_distance",
    f"SELECT g.grid_id, CAST(max(CASE WHEN {_DIST} <= 300 THEN 1 ELSE 0 END) AS INTEGER) AS within FROM grid g CROSS JOIN site s GROUP BY 1",
)
def _(r):
    return spatial.within_distance(_centres(r), r.site, "grid_id", "site_id", 300.0)


_T = "greatest(0.0, least(1.0, ((g.i*100+50 - s.x1)*(s.x2-s.x1) + (g.j*100+50 - s.y1)*(s.y2-s.y1)) / CAST(pow(s.x2-s.x1,2) + pow(s.y2-s.y1,2) AS DOUBLE)))"


@query(
    "jn8_line_distance",
    f"""SELECT grid_id, {R('min(CASE WHEN d <= 300 THEN d END)')} AS d FROM (SELECT grid_id,
        sqrt(pow(px - (x1 + t * (x2 - x1)), 2) + pow(py - (y1 + t * (y2 - y1)), 2)) AS d FROM (
        SELECT g.grid_id, g.i*100+50 AS px, g.j*100+50 AS py, s.x1, s.y1, s.x2, s.y2, {_T} AS t FROM grid g CROSS JOIN segment s)) GROUP BY 1""",
)
def _(r):
    return spatial.line_distance(_centres(r), r.segment, "grid_id", "seg_id", 300.0)


_TOP = "SELECT grid_id, i, j FROM scored ORDER BY round(risk_score, 9) DESC, grid_id LIMIT 20"


def _top(r):
    return topk.top_n(scored_v1(r).withColumn("s", F.round("risk_score", 9)), "s", "grid_id")


@query(
    "jn9_overlap_rate",
    f"""WITH z AS (SELECT DISTINCT x // 100 AS i, y // 100 AS j FROM site)
        SELECT count(*) AS listed, count(z.i) AS designated, {R('count(z.i) * 1.0 / count(*)')} AS overlap_rate
        FROM ({_TOP}) t LEFT JOIN z ON z.i = t.i AND z.j = t.j""",
)
def _(r):
    from rillgrid.functions.geo import cell_id

    zones = spatial.with_cell(r.site).select(cell_id("i", "j").alias("grid_id"))
    return validate.overlap_rate(_top(r), zones, "grid_id")


_EVENTS = """WITH wet AS (SELECT station, hour, mm, lag(hour) OVER (PARTITION BY station ORDER BY hour) AS prev FROM hourly WHERE mm > 0),
  marked AS (SELECT *, CASE WHEN prev IS NULL OR hour - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM wet),
  numbered AS (SELECT *, sum(s) OVER (PARTITION BY station ORDER BY hour) AS no FROM marked),
  spells AS (SELECT station, min(hour) AS event_start, max(hour) AS event_end, count(*) AS hours, sum(mm) AS mm FROM numbered GROUP BY station, no)"""


@query(
    "jn10_interval_join",
    f"""{_EVENTS} SELECT e.station, e.event_start, count(*) AS complaints FROM spells e JOIN complaint c
        ON c.station = e.station AND c.ts BETWEEN e.event_start AND e.event_end + INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def _(r):
    windows = rain.rain_events(rain.hourly_sum(r.rain), gap=6).select(
        "station", "event_start", (F.col("event_end") + F.expr("interval 1 hour")).alias("until")
    )
    met = rain.interval_join(windows, r.complaint.select("c_id", "station", "ts"), "station", "event_start", "until", "ts", ["c_id"])
    return met.groupBy("station", "event_start").agg(F.count(F.lit(1)).alias("complaints"))


@query(
    "jn11_rain_before",
    f"""SELECT c.c_id, {R('coalesce(sum(h.mm), 0)')} AS rain_before, max(CASE WHEN h.mm > 0 THEN h.hour END) AS last_wet_hour FROM complaint c
        LEFT JOIN hourly h ON h.station = c.station AND h.hour BETWEEN date_trunc('hour', c.ts) - INTERVAL 24 HOUR
        AND date_trunc('hour', c.ts) - INTERVAL 1 HOUR GROUP BY 1""",
)
def _(r):
    return rain.rain_before(r.complaint, rain.hourly_sum(r.rain), "c_id", "ts", 24)


@query(
    "jn12_gazetteer_lookup",
    """WITH book AS (SELECT hh_id, x, y, dong, segment FROM household), a AS (SELECT o_orderkey AS id, o_custkey AS lot,
          CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS road, o_custkey % 25 AS district FROM orders),
        lots AS (SELECT hh_id AS lot, x, y FROM book WHERE segment IN ('BUILDING', 'MACHINERY')), roads AS (SELECT hh_id AS road, x + 1 AS x, y FROM book WHERE segment IN ('HOUSEHOLD', 'FURNITURE')),
        districts AS (SELECT dong AS district, min(x) AS x, min(y) AS y FROM book WHERE dong < 20 GROUP BY 1)
        SELECT precision, count(*) AS n, CAST(coalesce(sum(x), 0) AS BIGINT) AS sx, CAST(coalesce(sum(y), 0) AS BIGINT) AS sy FROM (SELECT a.id,
          CASE WHEN l.lot IS NOT NULL THEN 'lot' WHEN r.road IS NOT NULL THEN 'road' WHEN d.district IS NOT NULL THEN 'district' ELSE 'unknown' END AS precision,
          coalesce(l.x, r.x, d.x) AS x, coalesce(l.y, r.y, d.y) AS y
          FROM a LEFT JOIN lots l ON l.lot = a.lot LEFT JOIN roads r ON r.road = a.road LEFT JOIN districts d ON d.district = a.district) GROUP BY 1""",
)
def _(r):
    wanted = r.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lot"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("road"), (F.col("o_custkey") % 25).alias("district")
    )
    book = r.household
    levels = [
        ("lot", book.where("segment in ('BUILDING', 'MACHINERY')").select(F.col("hh_id").alias("lot"), "x", "y")),
        ("road", book.where("segment in ('HOUSEHOLD', 'FURNITURE')").select(F.col("hh_id").alias("road"), (F.col("x") + 1).alias("x"), "y")),
        ("district", book.where("dong < 20").groupBy(F.col("dong").alias("district")).agg(F.min("x").alias("x"), F.min("y").alias("y"))),
    ]
    found = spatial.gazetteer_lookup(wanted, levels, ["id"])
    return found.groupBy("precision").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("sx"), F.coalesce(F.sum("y"), F.lit(0)).alias("sy"))


_MONTHS = """WITH r AS (SELECT last_day(ts) AS month_end, sum(mm) AS rain FROM rain_years GROUP BY 1),
  c AS (SELECT last_day(o_orderdate) AS month_end, count(*) AS complaints FROM orders GROUP BY 1)"""


@query(
    "jn13_time_join_monthly",
    f"""{_MONTHS} SELECT CAST(CAST(coalesce(r.month_end, c.month_end) AS DATE) AS VARCHAR) AS month_end, {R('coalesce(rain, 0)')} AS rain, coalesce(complaints, 0) AS complaints
        FROM r FULL OUTER JOIN c ON r.month_end = c.month_end""",
)
def _(r):
    return rain.monthly_pair(r.rain_years, r.table("orders"), "ts", "mm", "o_orderdate").withColumn("month_end", F.col("month_end").cast("string"))


@query(
    "jn14_cache_antijoin",
    """WITH cache AS (SELECT DISTINCT sha1(text) AS k FROM documents WHERE lang <> 'en')
       SELECT doc_id, sha1(text) AS text_key FROM documents WHERE sha1(text) NOT IN (SELECT k FROM cache)""",
)
def _(r):
    d = r.table("documents").select("doc_id", "lang", text_key("text").alias("text_key"))
    cache = d.where("lang <> 'en'").select("text_key").distinct()
    return topk.not_in(d.drop("lang"), cache, "text_key")


@query(
    "jn15_first_source",
    f"""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS v FROM customer WHERE c_mktsegment <> 'MACHINERY'),
        b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
        SELECT c.c_custkey AS k, {R('coalesce(a.v, b.v)')} AS v, CASE WHEN a.k IS NOT NULL THEN 'first' WHEN b.k IS NOT NULL THEN 'second' END AS src
        FROM customer c LEFT JOIN a ON a.k = c.c_custkey LEFT JOIN b ON b.k = c.c_custkey""",
)
def _(r):
    c = r.table("customer")
    a = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    b = r.table("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return spatial.first_source(c.select(F.col("c_custkey").alias("k")), [("first", a), ("second", b)], "k", ["v"])
