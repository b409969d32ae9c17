"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions import geo, scores, text
from rillgrid.operators import spatial
from rillgrid.plans.registry import R, query

# The test documents hold no Korean complaints; the same operator takes any list of patterns.
PATTERNS = (("odour", "smell|the"), ("backflow", "[Oo]verflow|que"), ("damage", "crack|und"))


def _match(t: str) -> str:
    out = "CASE "
    for label, p in PATTERNS:
        out += f"WHEN regexp_matches(coalesce({t}, ''), '{p}') THEN '{label}' "
    return out + "ELSE '기타' END"


@query("sf1_classify_keyword", f"SELECT doc_id, {_match('text')} AS type FROM documents")
def _(r):
    return r.table("documents").select("doc_id", text.classify_keyword("text", PATTERNS).alias("type"))


_EMAIL = text.EMAIL.replace("'", "''")
_PHONE = text.PHONE.replace("'", "''")
_NAME = text.NAME.replace("'", "''")


@query(
    "sf2_mask_pii",
    f"""SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}', '[PHONE]', 'g'), '{_NAME}', '\\1: [NAME]', 'g')) AS masked_key
        FROM documents""",
)
def _(r):
    return r.table("documents").select("doc_id", F.sha1(text.mask_pii("text").cast("binary")).alias("masked_key"))


@query("sf3_text_key", "SELECT doc_id, sha1(text) AS text_key FROM documents")
def _(r):
    return r.table("documents").select("doc_id", text.text_key("text").alias("text_key"))


# A complaint in front of every text, so that each field takes all its values.
_COMPLAINTS = ("창원대로 12 긴급 역류", "성산 12-3번지 침하 빨리", "상가 뒤 악취 호우", "용호동 넘침", "그냥 문의")
_LED = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{c} '" for k, c in enumerate(_COMPLAINTS)) + " END || coalesce(text, '')"


@query(
    "sf4_extract_fields",
    rf"""SELECT doc_id, regexp_matches(t, '비|호우|폭우|장마|rain|storm') AS rain_related,
        CAST(CASE WHEN regexp_matches(t, '긴급|위험|인명|즉시|urgent|danger') THEN 3 WHEN regexp_matches(t, '빨리|조속|신속|soon|quick') THEN 2 ELSE 1 END AS INTEGER) AS urgency,
        CASE WHEN regexp_matches(t, '악취|냄새') THEN '악취' WHEN regexp_matches(t, '역류|넘침|범람') THEN '역류' WHEN regexp_matches(t, '파손|파열|침하') THEN '파손' ELSE '기타' END AS type,
        CASE WHEN regexp_matches(t, '[0-9]+(-[0-9]+)?번지|[0-9]+-[0-9]+') THEN 'lot' WHEN regexp_matches(t, '[가-힣A-Za-z0-9]+(로|길)[ \t\n\f\r]?[0-9]+') THEN 'road'
          WHEN regexp_matches(t, '아파트|빌라|상가|building|apartment') THEN 'building' WHEN regexp_matches(t, '[^ \t\n\f\r]+?[동읍면리가]([ \t\n\f\r0-9]|$)') THEN 'district' ELSE 'unknown' END AS precision,
        coalesce(nullif(regexp_extract(t, '([가-힣A-Za-z0-9]+(로|길)[ \t\n\f\r]?[0-9]+|[0-9]+(-[0-9]+)?번지|[0-9]+-[0-9]+)', 1), ''), '-') AS location_text
        FROM (SELECT doc_id, {_LED} AS t FROM documents)""",
)
def _(r):
    led = F.concat(F.get(F.array(*[F.lit(f"{c} ") for c in _COMPLAINTS]), (F.col("doc_id") % 5).cast("int")), F.coalesce("text", F.lit("")))
    f = r.table("documents").select("doc_id", text.extract_fields(led).alias("f"))
    return f.select("doc_id", "f.rain_related", "f.urgency", "f.type", "f.precision", F.coalesce("f.location_text", F.lit("-")).alias("location_text"))


@query(
    "sf5_normalise_address",
    "SELECT s_suppkey, concat('NATION_', s_nationkey, '동 ', s_suppkey, '번지') AS address, concat('NATION_', s_nationkey, '동') AS district FROM supplier",
)
def _(r):
    raw = r.table("supplier").select(
        "s_suppkey", F.concat(F.lit("  NATION_"), F.col("s_nationkey").cast("string"), F.lit("동  \t"), F.col("s_suppkey").cast("string"), F.lit("번지 ")).alias("t")
    )
    clean = raw.select("s_suppkey", text.normalise_address("t").alias("address"))
    return clean.withColumn("district", text.district_of("address"))


@query(
    "sf6_date_parts",
    "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3",
)
def _(r):
    e = r.table("events").select(F.year("ts").alias("year"), F.month("ts").alias("month"), F.hour("ts").alias("hour"))
    return e.groupBy("year", "month", "hour").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sf7_distance",
    f"SELECT hh_id, {R('sqrt(pow(x - (dong // 5) * 800, 2) + pow(y - (dong % 5) * 800, 2))')} AS d FROM household",
)
def _(r):
    return r.household.select("hh_id", geo.distance("x", "y", F.floor(F.col("dong") / 5) * 800, F.col("dong") % 5 * 800).alias("d"))


_D = "sqrt(pow(x - (dong // 5) * 800, 2) + pow(y - (dong % 5) * 800, 2))"


@query("sf8_proximity_decay", f"SELECT hh_id, {R(f'greatest(0.0, 1 - {_D} / 300)')} AS near FROM household")
def _(r):
    d = geo.distance("x", "y", F.floor(F.col("dong") / 5) * 800, F.col("dong") % 5 * 800)
    return r.household.select("hh_id", geo.proximity_decay(d).alias("near"))


@query("sf9_capped_distance", f"SELECT hh_id, {R(f'least({_D}, 500) / 500')} AS far FROM household")
def _(r):
    d = geo.distance("x", "y", F.floor(F.col("dong") / 5) * 800, F.col("dong") % 5 * 800)
    return r.household.select("hh_id", geo.capped_distance(d, 500.0).alias("far"))


@query("sf10_cell_id", "SELECT hh_id, concat((x // 100) * 100, '_', (y // 100) * 100) AS grid_id FROM household")
def _(r):
    return r.household.select("hh_id", geo.cell_id(geo.cell_index("x"), geo.cell_index("y")).alias("grid_id"))


@query(
    "sf10_sequential_id",
    "SELECT i, j, concat('G', CASE WHEN i * 40 + j < 10000 THEN lpad(CAST(i * 40 + j AS VARCHAR), 4, '0') ELSE CAST(i * 40 + j AS VARCHAR) END) AS seq_id FROM grid",
)
def _(r):
    return spatial.grid_over(r.pipe).select("i", "j", geo.sequential_id("seq").alias("seq_id"))


@query("sf11_make_grid", "SELECT grid_id, i, j FROM grid")
def _(r):
    return r.grid


def tm_sql(lon: str, lat: str, epsg: int) -> tuple[str, str]:
    """The projection formula written out for the other engine."""
    g, k = geo.GRIDS[epsg], geo.Kruger
    t = f"sinh(atanh(sin(radians({lat}))) - {k.ecc!r} * atanh({k.ecc!r} * sin(radians({lat}))))"
    dl = f"radians({lon} - {g.lon0!r})"
    xi, eta = f"atan({t} / cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta] + [f"{a!r} * cos({2 * n} * {xi}) * sinh({2 * n} * {eta})" for n, a in enumerate(k.alpha, 1)])
    north = " + ".join([xi] + [f"{a!r} * sin({2 * n} * {xi}) * cosh({2 * n} * {eta})" for n, a in enumerate(k.alpha, 1)])
    size = g.scale * k.radius
    return f"{g.east!r} + {size!r} * ({east})", f"{g.north!r} + {size!r} * ({north} - {k.meridian(g.lat0)!r})"


_LON, _LAT = "(128.45 + (hh_id % 400) / 1000.0)::DOUBLE", "(35.05 + (hh_id % 300) / 1000.0)::DOUBLE"
_X, _Y = tm_sql("lon", "lat", 5179)


@query(
    "sf12_reproject_to_grid",
    f"SELECT hh_id, round({_X}, 3) + 0.0 AS x, round({_Y}, 3) + 0.0 AS y FROM (SELECT hh_id, {_LON} AS lon, {_LAT} AS lat FROM household)",
)
def _(r):
    p = r.household.select("hh_id", (F.lit(128.45) + F.col("hh_id") % 400 / 1000.0).alias("lon"), (F.lit(35.05) + F.col("hh_id") % 300 / 1000.0).alias("lat"))
    p = geo.reproject(p, "lon", "lat", 4326, 5179)
    return p.select("hh_id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query(
    "sf12_reproject_round_trip",
    f"SELECT hh_id, round({_LON}, 6) + 0.0 AS lon, round({_LAT}, 6) + 0.0 AS lat FROM household",
)
def _(r):
    """4326 to each grid in turn and back."""
    p = r.household.select("hh_id", (F.lit(128.45) + F.col("hh_id") % 400 / 1000.0).alias("a"), (F.lit(35.05) + F.col("hh_id") % 300 / 1000.0).alias("b"))
    source = 4326
    for target in (5179, 5181, 5186, 5187, 4326):
        p = geo.reproject(p, "a", "b", source, target, "a", "b")
        source = target
    return p.select("hh_id", F.col("a").alias("lon"), F.col("b").alias("lat"))


@query(
    "sf13_wetness_index",
    f"SELECT o_orderkey, {R('ln((o_custkey + 1) / greatest((o_orderkey % 50) / 1000.0, 0.001))')} AS twi FROM orders",
)
def _(r):
    return r.table("orders").select(
        "o_orderkey", scores.wetness_index(F.col("o_custkey") + 1, F.col("o_orderkey") % 50 / 1000.0).alias("twi")
    )


@query(
    "sf14_bayes_shrink",
    f"""SELECT dong, {R('(sum(CASE WHEN elderly THEN 1 ELSE 0 END) + 20 * (SELECT avg(CASE WHEN elderly THEN 1.0 ELSE 0.0 END) FROM household)) / (count(*) + 20)')} AS share
        FROM household GROUP BY 1""",
)
def _(r):
    h = r.household
    prior = h.agg(F.avg(F.col("elderly").cast("double")).alias("p")).scalar()
    per = h.groupBy("dong").agg(F.sum(F.col("elderly").cast("int")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return per.select("dong", scores.bayes_shrink("hits", "n", prior).alias("share"))


@query("sf15_weibull_defect", f"SELECT laid_year, {R('1 - exp(-pow(age / 60.0, 2.5))')} AS defect, count(*) AS n FROM pipe GROUP BY 1, 2")
def _(r):
    p = r.pipe.select("laid_year", scores.weibull_defect("age", 60.0, 2.5).alias("defect"))
    return p.groupBy("laid_year", "defect").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = ["~0.5", "0.5~1.0", "1.0~1.5", "1.5~2.0", "2.0~3.0", "3.0~", "none"]


@query(
    "sf16_depth_mid",
    "SELECT site_id, CASE site_id % 7 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 2 THEN 1.25 WHEN 3 THEN 1.75 WHEN 4 THEN 2.5 WHEN 5 THEN 3.5 END::DOUBLE AS mid FROM site",
)
def _(r):
    label = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("site_id") % 7 + 1).cast("int"))
    return r.site.select("site_id", scores.depth_mid(label).alias("mid"))


@query(
    "sf17_grade_fixed",
    f"""SELECT o_orderkey, CASE WHEN s = 0 THEN NULL WHEN s <= 0.2 THEN '안전' WHEN s <= 0.4 THEN '관심' WHEN s <= 0.6 THEN '주의' WHEN s <= 0.8 THEN '경계' ELSE '위험' END AS grade
        FROM (SELECT o_orderkey, (o_orderkey % 21) / 20.0 AS s FROM orders)""",
)
def _(r):
    return r.table("orders").select("o_orderkey", scores.grade_fixed(F.col("o_orderkey") % 21 / 20.0).alias("grade"))


@query(
    "sf18_grade_index",
    """SELECT o_orderkey, CASE WHEN s < 0.01 THEN '매우낮음' WHEN s < 0.25 THEN '낮음' WHEN s < 0.5 THEN '보통' WHEN s < 0.75 THEN '높음' ELSE '매우높음' END AS grade
       FROM (SELECT o_orderkey, (o_orderkey % 21) / 20.0 AS s FROM orders)""",
)
def _(r):
    return r.table("orders").select("o_orderkey", scores.grade_index(F.col("o_orderkey") % 21 / 20.0).alias("grade"))


@query(
    "sf19_matrix_grade",
    """WITH m(e, s, g) AS (VALUES (1,1,1),(1,2,1),(1,3,2),(1,4,2),(2,1,1),(2,2,2),(2,3,2),(2,4,3),(3,1,2),(3,2,2),(3,3,3),(3,4,4),(4,1,2),(4,2,3),(4,3,4),(4,4,4))
       SELECT o_orderkey, CAST(m.g AS INTEGER) AS grade FROM orders JOIN m ON m.e = o_orderkey % 4 + 1 AND m.s = o_custkey % 4 + 1""",
)
def _(r):
    return r.table("orders").select("o_orderkey", scores.matrix_grade(F.col("o_orderkey") % 4 + 1, F.col("o_custkey") % 4 + 1).alias("grade"))
