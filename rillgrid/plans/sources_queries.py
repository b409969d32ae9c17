"""Sources and sinks on data derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions.geo import cell_id
from rillgrid.operators.topk import top_n
from rillgrid.plans.registry import R, query
from rillgrid.plans.risk import grade_fixed_sql, scored_v1
from rillgrid.sources import catalog, raw, sinks
from rillgrid.staging import fresh_path

ITEM = "event_id bigint, ts string, mm double"

KOREAN_SEGMENTS = {"MACHINERY": "기계", "BUILDING": "건물", "AUTOMOBILE": "자동차", "FURNITURE": "가구", "HOUSEHOLD": "가정"}
KOREAN_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KOREAN_SEGMENTS.items())


@query("src1_load_dataset", "SELECT o_orderstatus, count(*) AS n, " + R("sum(o_totalprice)") + " AS total FROM orders GROUP BY 1")
def _(r):
    return r.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("src2_csv_encoding_fallback", f"SELECT CAST(c_custkey AS BIGINT) AS k, CASE c_mktsegment {KOREAN_SQL} END AS name FROM customer")
def _(r):
    """Two segments are written as cp949 files, the others as UTF-8."""
    r.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = fresh_path(r.spark, "korean")
    names = F.create_map(*[F.lit(x) for kv in KOREAN_SEGMENTS.items() for x in kv])
    rows = r.table("customer").select(F.col("c_custkey").alias("k"), F.element_at(names, F.col("c_mktsegment")).alias("name"))
    old = F.col("name").isin("건물", "가정")
    rows.where(old).write.option("header", True).option("encoding", raw.KOREAN).csv(path)
    rows.where(~old).write.mode("append").option("header", True).option("encoding", "UTF-8").csv(path)
    return raw.read_csv_kr(r.spark, path, "k bigint, name string")


def _pages(r):
    """API payloads of 100 readings each; the page number bounds the size of a group."""
    e = r.rain.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "mm")
    items = e.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(F.struct("event_id", "ts", "mm")).alias("item"))
    body = F.struct(F.struct(F.struct(F.col("item")).alias("items"), F.size("item").alias("numOfRows")).alias("body"))
    return items.select("page", F.to_json(F.struct(body.getField("body").alias("body"))).alias("inner")).select(
        "page", F.concat(F.lit('{"response":'), F.col("inner"), F.lit("}")).alias("payload")
    )


@query("src3_api_items", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, " + R("mm") + " AS mm FROM rain")
def _(r):
    return raw.api_items(_pages(r), "payload", ITEM)


@query("src4_union_pages", "SELECT event_id, " + R("mm") + " AS mm FROM rain")
def _(r):
    """Stored pages, some of them empty, read in one scan."""
    path = fresh_path(r.spark, "pages")
    full = _pages(r)
    empty = full.where("page % 10 = 0").select("page", F.lit('{"response":{"header":{"resultCode":"03"}}}').alias("payload"))
    full.unionByName(empty).select("page", "payload").withColumn("p", F.col("page") % 16).repartition("p").select("payload").write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    return raw.union_pages(r.spark, path, ITEM).select("event_id", "mm")


@query(
    "src5_load_years",
    "SELECT year(ts) AS year, count(*) AS n, " + R("sum(mm)") + " AS mm, CAST(0 AS BIGINT) AS corrupt FROM rain_years GROUP BY 1",
)
def _(r):
    path = fresh_path(r.spark, "years")
    r.rain_years.select("station", "ts", "mm", F.year("ts").alias("y")).write.partitionBy("y").option("header", True).csv(path)
    got = raw.load_years(r.spark, f"{path}/y=*", "station bigint, ts timestamp_ntz, mm double")
    return got.groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("mm").alias("mm"), F.count("_corrupt").alias("corrupt"))


@query(
    "src5_broken_rows",
    f"""SELECT year(ts) AS year, count(*) AS n, {R('sum(mm) FILTER (WHERE station % 7 <> 3)')} AS mm, count(*) FILTER (WHERE station % 7 = 3) AS corrupt
        FROM rain_years GROUP BY 1""",
)
def _(r):
    """Some stations write a word where their rain should stand."""
    path = fresh_path(r.spark, "years")
    mm = F.when(F.col("station") % 7 == 3, F.lit("none")).otherwise(F.col("mm").cast("string"))
    r.rain_years.select("station", "ts", mm.alias("mm"), F.year("ts").alias("y")).write.partitionBy("y").option("header", True).csv(path)
    got = raw.load_years(r.spark, f"{path}/y=*", "station bigint, ts timestamp_ntz, mm double")
    return got.groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("mm").alias("mm"), F.count("_corrupt").alias("corrupt"))


@query("src5_file_status", "SELECT CAST(station % 16 AS BIGINT) AS part, 'ok' AS status, count(*) AS lines FROM rain_years GROUP BY 1")
def _(r):
    """Archives of some stations each, in several files a part; every line of every file is read."""
    path = fresh_path(r.spark, "archives")
    part = (F.col("station") % 16).cast("long")
    r.rain_years.select(F.to_csv(F.struct("station", "ts", "mm")).alias("value"), part.alias("part")).write.partitionBy("part").option("compression", "gzip").text(path)
    found = raw.file_status(r.spark, f"{path}/part=*/*")
    return found.groupBy(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("long").alias("part"), "status").agg(F.sum("lines").alias("lines"))


def _features(r):
    """One FeatureCollection text per 50 polygons."""
    p = lambda k: F.array(F.col("ring")[k]["x"], F.col("ring")[k]["y"])
    ring = F.array(p(0), p(1), p(2), p(3), p(0))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("poly_id"), F.col("cover")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return (
        r.diamond.select(F.floor(F.col("poly_id") / 50).alias("page"), feature.alias("f")).groupBy("page")
        .agg(F.collect_list("f").alias("features"))
        .select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("features"))).alias("body"))
    )


@query(
    "src6_geojson_features",
    f"""SELECT poly_id, cover, 0 AS ring, k.seq AS seq,
        {R('CASE k.seq WHEN 0 THEN x + h WHEN 2 THEN x - h ELSE x END')} AS x, {R('CASE k.seq WHEN 1 THEN y + h WHEN 3 THEN y - h ELSE y END')} AS y
        FROM diamond CROSS JOIN (VALUES (0), (1), (2), (3)) k(seq)""",
)
def _(r):
    return raw.geojson_features(_features(r), "body", "poly_id bigint, cover string").drop("part")


@query(
    "src7_check_available",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, '{n}.parquet' AS file, {str(n not in ('embeddings', 'pages', 'benchmark', 'conversations')).lower()} AS required, true AS present, count(*) AS rows FROM {n}"
        for n in catalog.TABLES
    ),
)
def _(r):
    return catalog.check_available(r.spark, r.folder)


@query(
    "src8_file_inventory",
    " UNION ALL ".join(f"SELECT '{n}.parquet' AS file, '{n}' AS dataset, true AS has_bytes, count(*) AS rows FROM {n}" for n in catalog.TABLES),
)
def _(r):
    return catalog.file_inventory(r.spark, r.folder).select("file", "dataset", (F.col("length") > 0).alias("has_bytes"), "rows")


@query("snk1_save_csv", "SELECT o_orderkey, " + R("o_totalprice") + " AS o_totalprice, o_orderstatus FROM orders")
def _(r):
    path = sinks.save_csv(r.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), fresh_path(r.spark, "csv"))
    return r.spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").option("header", True).csv(path)


@query(
    "snk2_save_grid_geojson",
    """SELECT concat(i * 100, '_', j * 100) AS grid_id, count(*) AS n, CAST(i * 100 AS DOUBLE) AS x0, CAST(j * 100 AS DOUBLE) AS y0
       FROM (SELECT x // 100 AS i, y // 100 AS j FROM pipe) GROUP BY i, j""",
)
def _(r):
    from rillgrid.operators.spatial import with_cell

    cells = with_cell(r.pipe).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).withColumn("grid_id", cell_id("i", "j"))
    path = sinks.save_grid_geojson(cells, fresh_path(r.spark, "geojson"))
    shape = "properties struct<grid_id: string, n: bigint>, geometry struct<coordinates: array<array<array<double>>>>"
    back = r.spark.read.schema(shape).json(path)
    corner = F.col("geometry.coordinates")[0][0]
    return back.select("properties.grid_id", "properties.n", corner[0].alias("x0"), corner[1].alias("y0"))


@query(
    "snk3_save_top_table",
    f"SELECT grid_id, {R('risk_score')} AS risk_score, {grade_fixed_sql('risk_score')} AS risk_grade FROM scored ORDER BY round(risk_score, 9) DESC, grid_id LIMIT 20",
)
def _(r):
    top = top_n(scored_v1(r).withColumn("s", F.round("risk_score", 9)), "s", "grid_id")
    path = sinks.save_top_table(top.select("grid_id", "risk_score", "risk_grade"), fresh_path(r.spark, "top"))
    return r.spark.read.schema("grid_id string, risk_score double, risk_grade string").option("header", True).csv(path)
