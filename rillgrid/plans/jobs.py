"""Whole jobs: raw files to cleaned tables, and tables to the risk report.

A job is a chain of lazy transformations that ends in one write per result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.functions.scores import age_of, is_old
from rillgrid.functions.text import classify_keyword
from rillgrid.operators import cleaning, topk, validate
from rillgrid.sources import raw, sinks
from rillgrid.sources.roles import Roles


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the header's names and text columns, UTF-8 or cp949."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        names = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if any("\ufffd" in n for n in names) and raw.files_not_utf8(spark, path).take(1):
        return spark.read.option("header", True).option("encoding", raw.KOREAN).csv(path)
    return raw.read_csv_kr(spark, path, ", ".join(f"`{n.lstrip(chr(0xFEFF))}` string" for n in names))


def first_column(df: DataFrame, parts: Sequence[str]) -> str | None:
    found = cleaning.columns_matching(df, parts)
    return found[0] if found else None


def clean_sewer_pipes(df: DataFrame, region: Sequence[str]) -> DataFrame:
    return cleaning.coerce_numeric(cleaning.filter_any_column(df, region))


def clean_pumps(df: DataFrame, region: Sequence[str]) -> DataFrame:
    return cleaning.filter_any_column(df, region)


def clean_weather(df: DataFrame) -> DataFrame:
    """Date from ``tm``; rain columns without gaps; temperature columns with gaps as null."""
    out = df.withColumn("date", cleaning.parse_ts("tm")) if "tm" in df.columns else df
    out = cleaning.clean_rain(out, cleaning.columns_matching(df, ["rn", "강수"]))
    return cleaning.clean_temperature(out, cleaning.columns_matching(df, ["ta", "기온"]))


def clean_buildings(df: DataFrame, base: int = 2026) -> DataFrame:
    """Year, age and the flag of 30 years, from the first column that names a year."""
    year = first_column(df, ["년도", "년"])
    if year is None:
        return df
    out = df.withColumn("built_year", cleaning.to_number(year))
    return out.withColumn("age", age_of("built_year", base)).withColumn("is_old", is_old("age"))


def clean_complaints(df: DataFrame) -> DataFrame:
    """Received date (bad text becomes null) and class by keywords."""
    date, body = first_column(df, ["일", "일시", "날짜"]), first_column(df, ["유형", "내용", "구분"])
    out = df.withColumn("received_date", cleaning.parse_ts(date, strict=False)) if date else df
    return out.withColumn("type", classify_keyword(body)) if body else out


# Fixed value: the word that marks rows of the study region in the inputs.
REGION = ("창원",)

STEPS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "sewer_pipe": ("sewer_pipe.csv", lambda d: clean_sewer_pipes(d, REGION)),
    "pump_station": ("pump_station.csv", lambda d: clean_pumps(d, REGION)),
    "building": ("building_register.csv", clean_buildings),
    "complaint": ("sewer_complaints.csv", clean_complaints),
    "weather": ("weather_*.csv", clean_weather),
}


def preprocess(spark: SparkSession, folder: str, out: str, steps=None) -> DataFrame:
    """Clean every raw file into Parquet below ``out``: ``(dataset, status, detail)``.

    A dataset that is missing or fails is reported and does not stop the others.
    """
    report = []
    for name, (filename, clean) in (steps or STEPS).items():
        try:
            table = cleaning.trim_headers(clean(read_raw(spark, f"{folder}/{filename}")))
            table.write.mode("overwrite").parquet(f"{out}/{name}")
            report.append((name, "written", f"{out}/{name}"))
        except FileNotFoundError as e:
            report.append((name, "missing", str(e)))
        except Exception as e:  # noqa: BLE001 - one bad dataset must not hide the others
            report.append((name, "failed", f"{type(e).__name__}: {str(e)[:500]}"))
    return spark.createDataFrame(report, "dataset string, status string, detail string")


def collect_pages(spark: SparkSession, pages: str, item_schema: str, out: str) -> str:
    """Stored API pages to one Parquet table."""
    raw.union_pages(spark, pages, item_schema).write.mode("overwrite").parquet(out)
    return out


def risk_report(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Scored grid, top list and weight sensitivity of the first-generation index."""
    from rillgrid.plans.risk import scored_v1
    from rillgrid.staging import settle

    scored = settle(scored_v1(Roles(spark, folder)), "scored")
    top = topk.top_n(scored.withColumn("s", F.round("risk_score", 9)), "s", "grid_id")
    columns = ["grid_id", "flood_score", "sewer_score", "vuln_score", "risk_score", "risk_grade"]
    parts = ["flood_score", "sewer_score", "vuln_score"]
    scored.write.mode("overwrite").parquet(f"{out}/grid")
    return {
        "grid": f"{out}/grid",
        "map": sinks.save_grid_geojson(scored.select("i", "j", *columns), f"{out}/map"),
        "top": sinks.save_top_table(top.select(*columns), f"{out}/top"),
        "sensitivity": sinks.save_top_table(validate.weight_sensitivity(scored, parts, "grid_id"), f"{out}/sensitivity"),
    }
