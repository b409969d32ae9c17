"""Filters, coercion, missing values, validation, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.functions.scores import is_old
from rillgrid.operators import cleaning
from rillgrid.plans.registry import R, query


@query(
    "flt1_filter_any_column",
    "SELECT * FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '77') OR contains(c_name, '77') OR contains(c_mktsegment, '77') "
    "OR contains(CAST(c_nationkey AS VARCHAR), '77') OR contains(CAST(c_custkey AS VARCHAR), 'HOUSE') OR contains(c_name, 'HOUSE') OR contains(c_mktsegment, 'HOUSE') "
    "OR contains(CAST(c_acctbal AS VARCHAR), '77')",
)
def _(r):
    return cleaning.filter_any_column(r.table("customer"), ["77", "HOUSE"])


@query("flt2_filter_contains", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'bolt')")
def _(r):
    return cleaning.filter_contains(r.table("part").select("p_partkey", "p_name", "p_type"), "p_name", "bolt")


@query("flt3_filter_code_prefix", "SELECT s_name FROM supplier WHERE substr(substr(s_name, 10), 1, 8) BETWEEN '00000001' AND '00000007'")
def _(r):
    coded = r.table("supplier").withColumn("code", F.substring("s_name", 10, 9))
    return cleaning.filter_code_between(coded, "code", "00000001", "00000007", 8).select("s_name")


@query("flt4_filter_threshold", f"SELECT event_id, {R('mm')} AS mm FROM rain WHERE mm >= 50")
def _(r):
    return cleaning.filter_threshold(r.rain, "mm", 50).select("event_id", "mm")


@query(
    "cln1_coerce_numeric",
    f"""SELECT {R("sum(TRY_CAST(a AS DOUBLE))")} AS a_sum, count(TRY_CAST(a AS DOUBLE)) AS a_n, max(b) AS b_max, count(b) AS b_n FROM (
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS a,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' END AS b FROM orders)""",
)
def _(r):
    mixed = r.table("orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("a"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("x").alias("b"),
    )
    return cleaning.coerce_numeric(mixed).agg(
        F.sum("a").alias("a_sum"), F.count("a").alias("a_n"), F.max("b").alias("b_max"), F.count("b").alias("b_n")
    )


_DIRTY = "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN '-' ELSE CAST(event_id % 400 AS VARCHAR) || '.5' END"


def _dirty(r):
    k = F.col("event_id")
    text = F.when(k % 5 == 0, "").when(k % 7 == 0, "-").otherwise(F.concat((k % 400).cast("string"), F.lit(".5")))
    return r.rain.select("event_id", text.alias("sum_rn"), text.alias("avg_ta"))


@query("cln2_clean_rain", f"SELECT event_id, coalesce(TRY_CAST({_DIRTY} AS DOUBLE), 0.0) AS sum_rn FROM rain")
def _(r):
    d = _dirty(r)
    return cleaning.clean_rain(d, cleaning.columns_matching(d, ["rn", "강수"])).select("event_id", "sum_rn")


@query("cln3_clean_temperature", f"SELECT event_id, TRY_CAST({_DIRTY} AS DOUBLE) AS avg_ta FROM rain")
def _(r):
    d = _dirty(r)
    return cleaning.clean_temperature(d, cleaning.columns_matching(d, ["ta", "기온"])).select("event_id", "avg_ta")


@query(
    "cln4_parse_ts",
    """SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 9 <> 0) AS parsed, CAST(sum(day(ts)) AS BIGINT) AS strict_days,
       CAST(sum(CASE WHEN event_id % 9 <> 0 THEN day(ts) END) AS BIGINT) AS loose_days FROM events""",
)
def _(r):
    good = F.date_format("ts", "yyyy-MM-dd HH:mm")
    e = r.table("events").select(good.alias("tm"), F.when(F.col("event_id") % 9 == 0, "접수 미상").otherwise(good).alias("received"))
    strict = cleaning.parse_ts("tm", "yyyy-MM-dd HH:mm")
    loose = cleaning.parse_ts("received", "yyyy-MM-dd HH:mm", strict=False)
    return e.agg(
        F.count(F.lit(1)).alias("n"), F.count(loose).alias("parsed"),
        F.sum(F.day(strict)).alias("strict_days"), F.sum(F.day(loose)).alias("loose_days"),
    )


@query(
    "cln5_derive_age",
    """SELECT CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS approval_year, 2026 - CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS age,
       2026 - CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) >= 30 AS is_old, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def _(r):
    b = r.table("orders").select(cleaning.approval_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("approval_year"))
    b = b.withColumn("age", F.lit(2026) - F.col("approval_year")).withColumn("is_old", is_old("age"))
    return b.groupBy("approval_year", "age", "is_old").agg(F.count(F.lit(1)).alias("n"))


@query("cln6_thousands_number", "SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS amount FROM orders")
def _(r):
    text = r.table("orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("t"))
    return text.select("o_orderkey", cleaning.thousands_number("t").alias("amount"))


@query("cln7_trim_headers", "SELECT n_nationkey AS 연번, n_name AS 위치, count(s_suppkey) AS 위치_2 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def _(r):
    s = r.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("위 치"))
    wide = r.table("nation").join(s, "n_nationkey", "left").fillna(0, ["위 치"])
    return cleaning.trim_headers(wide.select(F.col("n_nationkey").alias("연 번"), F.col("n_name").alias("위    치"), F.col("위 치")))


_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"


def _holes(r):
    k = F.col("o_orderkey")
    return r.table("orders").select(
        "o_orderkey", F.when(k % 4 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 6 != 0, F.col("o_orderpriority")).alias("priority")
    )


@query("mis1_drop_missing", f"SELECT o_orderkey, {R('price')} AS price, priority FROM ({_HOLES}) WHERE price IS NOT NULL AND priority IS NOT NULL")
def _(r):
    return cleaning.handle_missing(_holes(r), "drop")


@query(
    "mis1_missing_report",
    f"""SELECT count(*) AS "before", count(*) FILTER (WHERE price IS NOT NULL AND priority IS NOT NULL) AS "after",
        count(*) FILTER (WHERE price IS NULL OR priority IS NULL) AS removed FROM ({_HOLES})""",
)
def _(r):
    return cleaning.missing_report(_holes(r))


@query(
    "mis2_fill_median",
    f"WITH h AS ({_HOLES}) SELECT o_orderkey, {R('coalesce(price, (SELECT quantile_cont(price, 0.5) FROM h))')} AS price, coalesce(priority, '미상') AS priority FROM h",
)
def _(r):
    return cleaning.handle_missing(_holes(r), "fill_median").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query(
    "mis3_fill_zero_and_median",
    f"SELECT grid_id, {R('old_pipe_ratio')} AS old_pipe_ratio, {R('mean_diameter')} AS mean_diameter, {R('mean_elev')} AS mean_elev FROM filled",
)
def _(r):
    from rillgrid.plans.risk import feature_table

    g = cleaning.fill_zero(feature_table(r), ["old_pipe_ratio"])
    return cleaning.fill_median(g, ["mean_diameter", "mean_elev"]).select("grid_id", "old_pipe_ratio", "mean_diameter", "mean_elev")


@query(
    "mis4_flag_and_fill",
    f"WITH h AS ({_HOLES}) SELECT o_orderkey, price IS NULL AS price_imputed, {R('coalesce(price, (SELECT quantile_cont(price, 0.5) FROM h))')} AS price FROM h",
)
def _(r):
    return cleaning.fill_median(_holes(r).select("o_orderkey", "price"), ["price"], flag=True)


@query(
    "mis5_missing_profile",
    f"""WITH h AS ({_HOLES}) SELECT 'price' AS column_name, 'double' AS dtype, {R('100.0 * count(*) FILTER (WHERE price IS NULL) / count(*)')} AS null_pct FROM h
        UNION ALL SELECT 'priority', 'string', {R('100.0 * count(*) FILTER (WHERE priority IS NULL) / count(*)')} FROM h""",
)
def _(r):
    return cleaning.missing_profile(_holes(r))


@query(
    "val1_validate_dataset",
    f"""WITH h AS (SELECT station, ts, CASE WHEN event_id % 30 = 0 THEN NULL ELSE mm END AS mm FROM rain), one AS (
        SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE mm IS NULL) AS DOUBLE) / count(*) AS miss, CAST(count(DISTINCT station) AS DOUBLE) AS st FROM h)
        SELECT 'row_count' AS rule, n AS observed, abs(n - 10000) <= 2000 AS ok FROM one
        UNION ALL SELECT 'null:mm', {R('miss')}, miss < 0.05 FROM one UNION ALL SELECT 'null:ts', 0.0, true FROM one
        UNION ALL SELECT 'stations', st, st > 0 FROM one UNION ALL SELECT 'columns_missing', 1.0, false FROM one""",
)
def _(r):
    holes = r.rain.withColumn("mm", F.when(F.col("event_id") % 30 != 0, F.col("mm")))
    return cleaning.validate_dataset(holes, 10_000, 0.2, ["mm", "ts", "level"], station="station")


@query("prj1_select_columns", f"SELECT dong, material, diameter, {R('length')} AS length, laid_year FROM pipe")
def _(r):
    return r.pipe.select("dong", "material", "diameter", "length", "laid_year")


@query(
    "prj2_unpivot_years",
    f"""SELECT material, CAST(laid_year AS VARCHAR) AS year, {R('sum(length)')} AS length FROM pipe WHERE laid_year IS NOT NULL GROUP BY 1, 2""",
)
def _(r):
    years = sorted(y["laid_year"] for y in r.pipe.where("laid_year IS NOT NULL").select("laid_year").distinct().collect())
    wide = r.pipe.groupBy("material").pivot("laid_year", years).agg(F.sum("length"))
    return cleaning.unpivot_years(wide, ["material"], [str(y) for y in years])
