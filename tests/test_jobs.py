"""Raw files to cleaned tables, stored pages to a table, tables to a report."""

import json

from rillgrid.plans import jobs


def test_preprocess_isolates_and_reports(spark, tmp_path):
    (tmp_path / "sewer_pipe.csv").write_bytes("시군구,관경,매설 연도\n창원시,300,1990\n부산시,200,2000\n창원시,x,2001\n창원시,400,2002\n".encode("cp949"))
    (tmp_path / "building_register.csv").write_text("건축년도,용도\n1996,주거\n1997,상가\n없음,상가\n", encoding="utf-8-sig")
    (tmp_path / "sewer_complaints.csv").write_text("접수일,내용\n2024-09-21,하수 역류\n미상,악취 신고\n2024-09-22,\n", encoding="utf-8")
    (tmp_path / "weather_daily_2023.csv").write_text("tm,sumRn,avgTa\n2023-01-01,,1.5\n", encoding="utf-8")
    (tmp_path / "weather_daily_2024.csv").write_text("tm,sumRn,avgTa\n2024-01-01,3.5,-\n", encoding="utf-8")
    out = str(tmp_path / "clean")
    report = {r["dataset"]: r["status"] for r in jobs.preprocess(spark, str(tmp_path), out).collect()}
    assert report == {"sewer_pipe": "written", "pump_station": "missing", "building": "written", "complaint": "written", "weather": "written"}
    pipes = spark.read.parquet(f"{out}/sewer_pipe")
    assert dict(pipes.dtypes) == {"시군구": "string", "관경": "double", "매설연도": "double"} and pipes.count() == 3
    old = {r["built_year"]: r["is_old"] for r in spark.read.parquet(f"{out}/building").collect()}
    assert old == {1996.0: True, 1997.0: False, None: None}
    assert sorted((str(r["received_date"])[:10], r["type"]) for r in spark.read.parquet(f"{out}/complaint").collect()) == [
        ("2024-09-21", "역류"), ("2024-09-22", "기타"), ("None", "악취")
    ]
    assert sorted((r["date"].year, r["sumRn"], r["avgTa"]) for r in spark.read.parquet(f"{out}/weather").collect()) == [(2023, 0.0, 1.5), (2024, 3.5, None)]


def test_pages_to_table(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for n in range(3):
        items = [{"tm": f"t{n}{k}", "rn": k} for k in range(n)]
        (tmp_path / "pages" / f"{n}.json").write_text(json.dumps({"response": {"body": {"items": {"item": items}}}}, indent=1))
    path = jobs.collect_pages(spark, str(tmp_path / "pages"), "tm string, rn double", str(tmp_path / "out"))
    assert spark.read.parquet(path).count() == 3


def test_risk_report(spark, tmp_path):
    paths = jobs.risk_report(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert spark.read.option("header", True).csv(paths["top"]).count() == 20
    assert spark.read.option("header", True).csv(paths["sensitivity"]).count() == 5
    assert spark.read.text(paths["map"]).count() == spark.read.parquet(paths["grid"]).count()
