"""Streams over the rain readings, drained into a Parquet sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.operators.ordering import with_ranks
from rillgrid.plans.registry import R, query
from rillgrid.sources.catalog import TABLES
from rillgrid.streaming import rain as streams


def _stream(r):
    return _readings(streams.read_events(r.spark, r.folder, "events.parquet", TABLES["events"].schema))


def _batch(r):
    return _readings(r.table("events"))


def _readings(e):
    # event time needs a zoned timestamp; the readings carry local time
    return e.select("event_id", F.floor(F.col("user_id") / 3).alias("station"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 5).alias("mm"))


def _local(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("st1_hourly_rain", f"SELECT station, hour, {R('mm')} AS mm FROM hourly")
def _(r):
    return _local(streams.drained(streams.hourly_rain, _stream(r), _batch(r), "hourly"), "hour")


@query(
    "st2_rolling_rain",
    f"""SELECT station, s AS start, s + INTERVAL 3 HOUR AS "end", {R('sum(mm)')} AS mm FROM (SELECT station, mm, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS s
        FROM rain CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) x) GROUP BY 1, 2""",
)
def _(r):
    return _local(streams.drained(streams.rolling_rain, _stream(r), _batch(r), "rolling", span_hours=3), "start", "end")


@query(
    "st2_rolling_rain_24h",
    f"""SELECT station, s AS start, s + INTERVAL 24 HOUR AS "end", {R('sum(mm)')} AS mm FROM (SELECT station, mm, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS s
        FROM rain CROSS JOIN (SELECT unnest(range(24)) AS k) x) GROUP BY 1, 2""",
)
def _(r):
    """Sums over a day that move on by one hour."""
    day = lambda rain: streams.rolling_rain(rain, 24)
    return _local(streams.drained(day, _stream(r), _batch(r), "rolling-day", span_hours=24), "start", "end")


@query(
    "st3_rain_sessions",
    f"""WITH a AS (SELECT station, ts, mm, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS prev FROM rain),
        b AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY ts) AS no FROM a)
        SELECT station, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", {R('sum(mm)')} AS mm, count(*) AS readings FROM b GROUP BY station, no""",
)
def _(r):
    return _local(streams.drained_sessions(_stream(r), _batch(r), "sessions"), "start", "end")


@query("st4_dedupe", f"SELECT event_id, station, ts, {R('mm')} AS mm FROM rain")
def _(r):
    """Every reading arrives twice."""
    twice = _stream(r).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _local(streams.run_available(streams.dedupe(twice), "dedupe"), "ts")


@query(
    "st5_alerts",
    f"""WITH t AS (SELECT s_suppkey AS cell, s_suppkey % 50 AS station, {R('s_acctbal')} AS capacity FROM supplier),
        p AS (SELECT *, percent_rank() OVER (ORDER BY capacity) AS pct FROM t)
        SELECT r.station, r.ts, {R('r.mm')} AS mm, p.cell, p.capacity FROM rain r JOIN p ON p.station = r.station WHERE r.mm >= 50 AND p.pct >= 0.8""",
)
def _(r):
    """Heavy readings against the best-scored fifth of the listed places."""
    places = r.table("supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") % 50).alias("station"), F.round("s_acctbal", 6).alias("capacity"))
    listed = with_ranks(places, "capacity", ["cell"]).where("pct_rank >= 0.8").select("cell", "station", "capacity")
    out = streams.run_available(streams.alerts(_stream(r).drop("event_id"), listed, 50), "alerts")
    return _local(out, "ts").drop("message")
