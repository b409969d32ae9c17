"""Hand-made frames: nulls, constants, ties, edges, encodings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.functions import geo, scores, text
from rillgrid.operators import aggregates, cleaning, index, normalise, ordering, rain, topk, validate
from rillgrid.sources import catalog, raw, sinks


def col(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_constant_column_scales_to_zero_and_inverts_to_one(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(5)], "k int, x double")
    out = normalise.minmax(normalise.minmax(df, {"x": "a"}), {"x": "b"}, invert=["x"])
    assert set(col(out, "a")) == {0.0} and set(col(out, "b")) == {1.0}
    assert set(col(normalise.zscore(df, {"x": "z"}), "z")) == {0.0}


def test_all_null_column(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)], "k int, x double")
    assert set(col(normalise.minmax(df, {"x": "a"}), "a")) == {None}
    assert set(col(cleaning.fill_median(df, ["x"]), "x")) == {None}
    assert cleaning.missing_profile(df).collect()[0]["null_pct"] == 100.0


def test_numeric_coercion_needs_more_than_half(spark):
    rows = [("1", "1", "1,5")] * 4 + [("x", "2", "2,000")] + [("x", "x", "3")] * 3
    df = spark.createDataFrame(rows, "half string, most string, sep string")
    out = cleaning.coerce_numeric(df)
    assert dict(out.dtypes) == {"half": "string", "most": "double", "sep": "string"}
    assert col(df.select(cleaning.thousands_number("sep").alias("n")).distinct(), "n", "n") == [3.0, 15.0, 2000.0]


def test_grades_at_their_edges(spark):
    s = [0.0, 0.01, 0.2, 0.25, 0.4, 0.5, 0.6, 0.75, 0.8, 1.0, None]
    df = spark.createDataFrame(list(enumerate(s)), "k int, s double")
    out = df.select("k", scores.grade_fixed("s").alias("f"), scores.grade_index("s").alias("b"), scores.grade_fixed("s", True).alias("low")).orderBy("k").collect()
    g, b = scores.FIXED_GRADES, scores.INDEX_GRADES
    assert [r["f"] for r in out] == [None, g[0], g[0], g[1], g[1], g[2], g[2], g[3], g[3], g[4], None]
    assert [r["b"] for r in out] == [b[0], b[1], b[1], b[2], b[2], b[3], b[3], b[4], b[4], b[4], None]
    assert out[0]["low"] == g[0]


def test_points_on_cell_edges_belong_to_one_cell(spark):
    df = spark.createDataFrame([(0.0, 0.0), (99.999, 0.0), (100.0, 0.0), (0.0, 100.0), (-0.001, 0.0)], "x double, y double")
    out = df.select(geo.cell_index("x").alias("i"), geo.cell_index("y").alias("j")).collect()
    assert [(r["i"], r["j"]) for r in out] == [(0, 0), (0, 0), (1, 0), (0, 1), (-1, 0)]


def test_top_n_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(f"c{i:02d}", 1.0) for i in range(25)], "k string, s double")
    assert col(topk.top_n(df, "s", "k", 20), "k") == [f"c{i:02d}" for i in range(20)]


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1), (1, 0.1)], "y int, s double")
    # pairs: (.9 beats both), (.5 ties .5, beats .1), (.1 loses to .5, ties .1)
    assert validate.roc_auc(df, "y", "s").first()["auc"] == pytest.approx((2 + 1.5 + 0.5) / 6)
    assert validate.pr_auc(df, "y", "s").first()["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_classification_is_first_match_and_null_is_other(spark):
    rows = ["악취와 역류", "하수 넘침", "도로 침하", "문의", None]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "k int, t string").select("k", text.classify_keyword("t").alias("c"))
    assert col(out, "c", "k") == ["악취", "역류", "파손", "기타", "기타"]


def test_masking(spark):
    t = "성명: 아무개, 010-1234-5678 로 연락, a.b@c.org"
    masked = spark.createDataFrame([(t,)], "t string").select(text.mask_pii("t").alias("m")).first()["m"]
    assert "1234" not in masked and "a.b@c.org" not in masked and "아무개" not in masked


def test_extracted_fields(spark):
    row = spark.createDataFrame([("호우로 중앙로 12 역류, 긴급",)], "t string").select(text.extract_fields("t").alias("f")).first()["f"]
    assert (row["location_text"], row["type"], row["rain_related"], row["urgency"], row["precision"]) == ("중앙로 12", "역류", True, 3, "road")


def test_fields_equal_the_plain_patterns(spark):
    parts = ["중앙로 12", "가길3", "로", "길 7", "성산", "12-3번지", "1-2-3", "45번지", "번지", "9", "-", "동", "리 ", "면1", "읍\n", "a", "Z9", " ", "\t", "아파트", "urgent", "비", "역류", "\u2028", "😀", "."]
    draw = np.random.default_rng(5)
    rows = [(i, "".join(draw.choice(parts, draw.integers(0, 7)))) for i in range(4000)] + [(4000, None)]
    t, lot, road = F.coalesce("t", F.lit("")), r"\d+(-\d+)?번지|\d+-\d+", r"[가-힣A-Za-z0-9]+(로|길)\s?\d+"
    place, district = F.regexp_extract(t, f"({road}|{lot})", 1), F.regexp_extract("t", r"(\S+?[동읍면리가])(?:\s|$|\d)", 1)
    sort = F.when(t.rlike(lot), "lot").when(t.rlike(road), "road").when(t.rlike(text.BUILDING), "building").when(F.coalesce(district, F.lit("")) != "", "district")
    out = spark.createDataFrame(rows, "k int, t string").select(
        "k", "t", text.extract_fields("t").alias("f"), text.district_of("t").alias("d"), F.when(place != "", place).alias("place"), F.when(district != "", district).alias("district"),
        F.coalesce(sort, F.lit("unknown")).alias("sort"), t.rlike(text.RAIN_WORDS).alias("rain"), t.rlike(text.URGENT_WORDS).alias("urgent"),
    ).collect()
    assert len({r["sort"] for r in out}) == 5
    for r in out:
        assert (r["f"]["location_text"], r["f"]["precision"], r["d"], r["f"]["rain_related"], r["f"]["urgency"] == 3) == (r["place"], r["sort"], r["district"], r["rain"], r["urgent"]), r["t"]


def test_fields_of_a_long_word_cost_its_length(spark):
    import time

    rows = [(k, c * 400_000) for k, c in enumerate(("a", "7", "가"))]
    frame = spark.createDataFrame(rows, "k int, t string").select(text.extract_fields("t").alias("f"), text.district_of("t").alias("d"))
    start = time.time()
    assert [(r["f"]["precision"], r["d"] is None) for r in frame.collect()][:2] == [("unknown", True)] * 2
    assert time.time() - start < 20  # each word was tried again from each of its characters


def test_catalog_errors(spark, tmp_path):
    with pytest.raises(KeyError):
        catalog.load_dataset(spark, str(tmp_path), "nothing")
    with pytest.raises(FileNotFoundError):
        catalog.load_dataset(spark, str(tmp_path), "pump_station", catalog=catalog.DOMAIN)
    with pytest.raises(ValueError):
        catalog.load_dataset(spark, str(tmp_path), "pump_station", "pump.img", catalog=catalog.DOMAIN)


def test_cp949_and_utf8_files_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,name\n1,창원\n".encode("cp949"))
    (tmp_path / "b.csv").write_bytes("k,name\n2,역류\n".encode("utf-8"))
    out = raw.read_csv_kr(spark, str(tmp_path), "k int, name string")
    assert {(r["k"], r["name"]) for r in out.collect()} == {(1, "창원"), (2, "역류")}


def test_api_pages_with_empty_and_missing_items(spark):
    pages = [
        '{"response":{"body":{"items":{"item":[{"tm":"a","rn":1.5},{"tm":"b"}]}}}}',
        '{"response":{"body":{"items":{"item":[]}}}}',
        '{"response":{"header":{"code":"03"}}}',
    ]
    out = raw.api_items(spark.createDataFrame([(p,) for p in pages], "v string"), "v", "tm string, rn double")
    assert sorted((r["tm"], r["rn"]) for r in out.collect()) == [("a", 1.5), ("b", None)]


def test_multipolygon_features(spark):
    body = '{"features":[{"properties":{"id":1},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}'
    out = raw.geojson_features(spark.createDataFrame([(body,)], "b string"), "b", "id int").collect()
    assert len(out) == 6 and {r["part"] for r in out} == {0, 1}


def test_top_table_refuses_long_lists(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.save_top_table(spark.range(20).toDF("k"), str(tmp_path / "t"), most=10)


def test_headers_are_trimmed(spark):
    assert cleaning.trim_headers(spark.createDataFrame([(1, 2, 3)], ["연 번", "위  치", "위치"])).columns == ["연번", "위치", "위치_2"]


def test_ahp_consistent_and_inconsistent(spark):
    def answers(a12, a13, a23):
        up = {(1, 2): a12, (1, 3): a13, (2, 3): a23}
        rows = [(0, i, j, v) for (i, j), v in up.items()] + [(0, j, i, 1 / v) for (i, j), v in up.items()] + [(0, i, i, 1.0) for i in (1, 2, 3)]
        return spark.createDataFrame(rows, "respondent int, i int, j int, value double")

    good = index.ahp_weights(answers(2.0, 4.0, 2.0)).orderBy("item").collect()
    assert [r["w"] for r in good] == pytest.approx([4 / 7, 2 / 7, 1 / 7]) and abs(good[0]["cr"]) < 1e-9
    assert index.ahp_weights(answers(9.0, 1 / 9, 9.0)).first()["cr"] > 0.1


def test_jenks_on_clear_groups(spark):
    values = [1.0, 1.1, 1.2, 5.0, 5.1, 9.0, 9.2, 20.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert normalise.jenks_breaks(df, "v", 4) == [1.2, 5.1, 9.2]


def exact_breaks(values, k):
    """Fisher's recurrence over all distinct values."""
    v, n = np.unique(np.array(values), return_counts=True)
    c = v - np.average(v, weights=n)
    cn, cs, cq = (np.concatenate(([0.0], np.cumsum(x))) for x in (n, n * c, n * c * c))
    spread = lambda i, j: (cq[j] - cq[i]) - (cs[j] - cs[i]) ** 2 / (cn[j] - cn[i])
    cost, cuts = np.array([np.inf] + [spread(0, j) for j in range(1, len(v) + 1)]), []
    for part in range(2, k + 1):
        best, where = np.full(len(v) + 1, np.inf), np.zeros(len(v) + 1, dtype=int)
        for j in range(part, len(v) + 1):
            i = np.arange(part - 1, j)
            total = cost[i] + spread(i, j)
            best[j], where[j] = total.min(), i[total.argmin()]
        cost = best
        cuts.append(where)
    out, j = [], len(v)
    for where in reversed(cuts):
        j = where[j]
        out.append(float(v[j - 1]))
    return out[::-1]


@pytest.mark.parametrize("tail", [[], [1e6], [1e6] * 30, [1e3, 1e6, 1e9]])
def test_jenks_under_a_heavy_tail(spark, tail):
    """A far value takes a class of its own and merges no others."""
    rng = np.random.default_rng(3)
    groups = [float(x) for lo in (0, 30, 60, 100) for x in rng.integers(0, 200, 60) / 100 + lo]
    many = [float(x) for lo in (0, 30, 60, 100) for x in rng.normal(lo, 2, 900)]
    for values in (groups, many):
        df = spark.createDataFrame([(v,) for v in values + tail] + [(None,), (float("nan"),)], "v double").repartition(4)
        assert normalise.jenks_breaks(df, "v", 4 + len(set(tail))) == exact_breaks(values + tail, 4 + len(set(tail)))
    assert normalise.jenks_breaks(df.limit(0), "v") == [] and normalise.jenks_breaks(spark.createDataFrame([(1.0,)] * 3, "v double"), "v") == []


def test_jenks_bins_beat_plain_splits(spark):
    df = spark.range(4000).select((F.pow(F.rand(7), 3) * 100).alias("v")).cache()
    breaks = normalise.jenks_breaks(df, "v", 5)
    width = [20.0, 40.0, 60.0, 80.0]
    equal = [r["q"] for r in ordering.quantiles(df, ["v"], [0.2, 0.4, 0.6, 0.8]).orderBy("p").collect()]

    def sse(b):
        coded = df.withColumn("c", scores.class_code("v", b))
        return coded.groupBy("c").agg((F.var_pop("v") * F.count("v")).alias("s")).agg(F.sum("s")).first()[0]

    assert sse(breaks) <= min(sse(width), sse(equal)) * 1.0001


def test_vif_of_independent_and_copied_columns(spark):
    df = spark.range(500).select(F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("c", F.col("a") + F.randn(3) * 0.1).cache()
    v = {r["feature"]: r["vif"] for r in aggregates.vif(df, ["a", "b", "c"]).collect()}
    assert v["b"] < 1.2 and v["a"] > 20


def test_projection_round_trip_below_a_millimetre(spark):
    pts = spark.createDataFrame([(128.45 + i * 0.02, 35.05 + i * 0.015) for i in range(20)], "lon double, lat double")
    there = geo.reproject(pts, "lon", "lat", 4326, 5179)
    other = geo.reproject(there, "x", "y", 5179, 5187, "a", "b")
    back = geo.reproject(other, "a", "b", 5187, 5179, "x2", "y2")
    worst = back.agg(F.max(F.abs(F.col("x") - F.col("x2"))), F.max(F.abs(F.col("y") - F.col("y2")))).first()
    assert max(worst) < 1e-3
    origin = spark.createDataFrame([(127.5, 38.0)], "lon double, lat double")
    o = geo.reproject(origin, "lon", "lat", 4326, 5179).first()
    assert math.isclose(o["x"], 1_000_000, abs_tol=1e-6) and math.isclose(o["y"], 2_000_000, abs_tol=1e-6)


def test_a_replacement_character_does_not_make_a_file_korean(spark, tmp_path):
    (tmp_path / "u.csv").write_text("k,name\n1,창원\ufffd\n", encoding="utf-8")
    (tmp_path / "k.csv").write_bytes("k,name\n2,창원\n".encode("cp949"))
    out = {r["k"]: r["name"] for r in raw.read_csv_kr(spark, str(tmp_path), "k int, name string").collect()}
    assert out == {1: "창원\ufffd", 2: "창원"}


def test_single_item_and_broken_pages(spark):
    pages = ['{"response":{"body":{"items":{"item":{"tm":"a","rn":1}}}}}', '{"response":{"body":{"items":{"item":[{"tm":"b","rn":2},{"tm":"c","rn":3}]}}}}', "<html>busy</html>", None, '{"response":{"body":{"items":""}}}']
    df = spark.createDataFrame([(p,) for p in pages], "v string")
    assert sorted(r["tm"] for r in raw.api_items(df, "v", "tm string, rn double").collect()) == ["a", "b", "c"]
    assert tuple(raw.unreadable_pages(df, "v").first()) == (5, 2)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i), float(i * i)) for i in range(5)], "a double, b double, c double")
    r = {(x["a"], x["b"]): x["r"] for x in aggregates.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert r["a", "b"] is None and r["a", "a"] is None and abs(r["b", "b"] - 1) < 1e-12
    assert {x["feature"]: round(x["vif"], 3) for x in aggregates.vif(df, ["a", "b", "c"]).collect()}["a"] == 1.0
    hours = spark.sql("SELECT 1 AS station, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) AS hour, 0.0D AS mm, id * 1.0D AS level FROM range(5)")
    assert {x["r"] for x in rain.lag_response(hours.drop("level"), hours.drop("mm"), 2).collect()} == {None}


def test_entropy_weights_without_spread(spark):
    for rows in ([(1.0, 2.0)], [(1.0, 2.0)] * 4):
        w = index.entropy_weights(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()
        assert [round(x["w"], 9) for x in w] == [0.5, 0.5]


@pytest.mark.parametrize("zone", ["Asia/Seoul", "America/New_York"])
def test_hours_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT 1 AS station, ts, 1.0D AS mm FROM VALUES (timestamp_ntz'2024-03-10 02:30:15.5'), (timestamp_ntz'2024-03-10 03:30:00'), (timestamp_ntz'1987-05-10 02:10:00') AS t(ts)")
        hourly = rain.hourly_sum(df)
        assert {str(r["hour"]) for r in hourly.collect()} == {"2024-03-10 02:00:00", "2024-03-10 03:00:00", "1987-05-10 02:00:00"}
        assert {(str(r["hour"]), r["mm_3h"]) for r in rain.rolling_sums(hourly, [3]).collect()} == {("2024-03-10 02:00:00", 1.0), ("2024-03-10 03:00:00", 2.0), ("1987-05-10 02:00:00", 1.0)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, t string")
    assert tuple(cleaning.missing_report(df).first()) == (4, 1, 3) and cleaning.handle_missing(df).count() == 1


def test_a_broken_file_stops_no_other(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"k,v\n3,4\n" * 5000)[:60])
    (tmp_path / "c.csv").write_text("k,v\n5,x\n")
    rows = raw.load_years(spark, str(tmp_path / "*"), "k int, v int").collect()
    assert {(r["file"], r["k"]) for r in rows if r["file"] != "b.csv.gz"} == {("a.csv", 1), ("c.csv", 5)}
    assert [r["_corrupt"] for r in rows if r["file"] == "c.csv"] == ["5,x"]
    assert raw.broken_files(spark, str(tmp_path / "*")) == ["b.csv.gz"]


def test_status_of_files(spark, tmp_path):
    import bz2
    import gzip

    body = b"k,v\n" + b"3,4\n" * 5000
    files = {
        "whole.csv": body, "open_end.csv": body[:-1], "none.csv": b"", "whole.csv.gz": gzip.compress(body), "two.csv.gz": gzip.compress(body) + gzip.compress(body),
        "whole.csv.bz2": bz2.compress(body), "cut.csv.gz": gzip.compress(body)[:-9], "cut.csv.bz2": bz2.compress(body)[:40], "text.csv.gz": body, "none.csv.gz": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["file"]: r for r in raw.file_status(spark, str(tmp_path / "*")).collect()}
    assert {f: r["bytes"] for f, r in rows.items()} == {f: len(data) for f, data in files.items() if data}
    assert {f for f, r in rows.items() if r["status"] == "broken"} == {"cut.csv.gz", "cut.csv.bz2", "text.csv.gz"} == set(raw.broken_files(spark, str(tmp_path / "*")))
    lines = {f: r["lines"] for f, r in rows.items() if r["status"] == "ok"}
    assert lines == {"whole.csv": 5001, "open_end.csv": 5001, "whole.csv.gz": 5001, "two.csv.gz": 10002, "whole.csv.bz2": 5001}


def test_a_folder_of_parts_is_one_row_of_the_inventory(spark, tmp_path):
    spark.range(40).selectExpr("CAST(id AS INT) AS r_regionkey", "'x' AS r_name").repartition(3).write.parquet(str(tmp_path / "region.parquet"))
    spark.range(0).selectExpr("CAST(id AS INT) AS n_nationkey", "'x' AS n_name", "0 AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "region.parquet").glob("*.parquet"))
    found = {r["file"]: tuple(r)[1:] for r in catalog.file_inventory(spark, str(tmp_path)).collect()}
    assert found["region.parquet"] == ("region", size, 40) and found["nation.parquet"][2] == 0 and len(found) == 2
    there = {r["dataset"] for r in catalog.check_available(spark, str(tmp_path)).where("present").collect()}
    assert there == {"region", "nation"}
