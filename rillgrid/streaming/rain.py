"""Structured Streaming jobs over rain readings ``(station, ts, mm)``.

Every job is a plain transformation of a streaming frame, so the same function also runs on a
batch frame; ``run_available`` drains what is there into a Parquet sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.staging import fresh_path


def read_events(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    )


def hourly_rain(rain: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly sums by station; readings later than ``late`` are dropped."""
    return rain.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "station").agg(F.sum("mm").alias("mm")).select(
        "station", F.col("w.start").alias("hour"), "mm"
    )


def rolling_rain(rain: DataFrame, hours: int = 3, late: str = "2 hours") -> DataFrame:
    """Sums over ``hours`` that move on by one hour."""
    return rain.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", "1 hour").alias("w"), "station").agg(
        F.sum("mm").alias("mm")
    ).select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mm")


def rain_sessions(rain: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Rain events: readings of a station closer than ``gap``."""
    return rain.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "station").agg(
        F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("readings")
    ).select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mm", "readings")


def dedupe(rain: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings fetched twice count once."""
    return rain.withWatermark("ts", late).dropDuplicatesWithinWatermark(["station", "ts"])


def alerts(rain: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """Heavy readings with the listed cells of their station (a static table)."""
    return rain.where(F.col("mm") >= F.lit(least)).join(cells, "station").select(
        "station", "ts", "mm", *[c for c in cells.columns if c != "station"],
        F.concat(F.lit("rain "), F.format_number("mm", 1), F.lit(" mm at station "), F.col("station").cast("string")).alias("message"),
    )


def drained(make, stream: DataFrame, readings: DataFrame, name: str, late_hours: int = 2, span_hours: int = 1) -> DataFrame:
    """All windows of a finite source: what the stream emits, and as a batch those that its last watermark leaves open.

    ``make`` builds the windows from a frame; ``readings`` is the source as a batch.  Open windows end after
    the latest reading less ``late_hours`` and hold readings of at most ``span_hours`` before that.
    """
    closed = run_available(make(stream), name)
    last = readings.agg(F.max("ts").alias("ts")).select((F.col("ts") - F.expr(f"INTERVAL {late_hours} HOURS")).alias("ts")).first()["ts"]
    if last is None:
        return closed
    tail = make(readings.where(F.col("ts") >= F.lit(last) - F.expr(f"INTERVAL {span_hours} HOURS")))
    ends = F.col("end") if "end" in closed.columns else F.col("hour") + F.expr("INTERVAL 1 HOUR")
    return closed.union(tail.where(ends > F.lit(last)))


def drained_sessions(stream: DataFrame, readings: DataFrame, name: str, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """All rain events of a finite source: the emitted ones, and those of the readings after a station's last emitted one."""
    closed = run_available(rain_sessions(stream, gap, late), name)
    until = closed.groupBy(F.col("station").alias("_s")).agg(F.max("end").alias("_until"))
    open_rows = readings.join(until, F.col("station").eqNullSafe(F.col("_s")), "left").where("_until IS NULL OR ts >= _until").drop("_s", "_until")
    return closed.union(rain_sessions(open_rows, gap, late))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything that is available, then read the sink."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
