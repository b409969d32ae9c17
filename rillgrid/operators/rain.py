"""Rain series: hourly totals, rolling sums, separated events, calendars, lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.operators.aggregates import pearson
from rillgrid.skew import salted_join

BUCKET = 720  # hours per window partition: 30 days


def hour_of(ts) -> F.Column:
    """The full hour of a local clock; the session's zone plays no part."""
    local = F.col(ts).cast("timestamp_ntz")
    return local - F.make_dt_interval(mins=F.minute(local), secs=F.extract(F.lit("SECOND"), local))


def hourly_sum(rain: DataFrame, station: str = "station", ts: str = "ts", mm: str = "mm") -> DataFrame:
    """Any finer series to ``(station, hour, mm)``.

    This is the pre-aggregation in front of every window below: afterwards one station has at
    most one row per hour, however many readings it sent.
    """
    return rain.groupBy(F.col(station).alias("station"), hour_of(ts).alias("hour")).agg(
        F.sum(mm).alias("mm")
    )


def merge_networks(*hourly: DataFrame) -> DataFrame:
    out = hourly[0]
    for other in hourly[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def _hour_number(c) -> F.Column:
    local = F.col(c).cast("timestamp_ntz")
    return F.unix_date(F.to_date(local)).cast("long") * 24 + F.hour(local)


def _bucketed(hourly: DataFrame, context: int) -> DataFrame:
    """Cut every station into 30-day buckets; the last ``context`` hours of a bucket are also
    listed in the next one (``_own`` tells the copies from the originals)."""
    h = hourly.withColumn("_h", _hour_number("hour"))
    own = F.floor(F.col("_h") / BUCKET).cast("long")
    later = F.floor((F.col("_h") + context) / BUCKET).cast("long")
    return h.withColumn("_own_b", own).withColumn("_b", F.explode(F.sequence(own, later))).withColumn(
        "_own", F.col("_b") == F.col("_own_b")
    ).drop("_own_b")


def rolling_sums(hourly: DataFrame, hours: Sequence[int] = (3, 24)) -> DataFrame:
    """Trailing sums over the last ``h`` hours, the current hour included."""
    out = _bucketed(hourly, max(hours) - 1)
    w = Window.partitionBy("station", "_b").orderBy("_h")
    for h in hours:
        out = out.withColumn(f"mm_{h}h", F.sum("mm").over(w.rangeBetween(-(h - 1), 0)))
    return out.where("_own").drop("_h", "_b", "_own")


def event_hours(hourly: DataFrame, gap: int = 6, wet: float = 0.0) -> DataFrame:
    """Wet hours with the start of their rain event.

    A new event starts when the ``gap`` hours before hold no rain.  Starts are found inside
    buckets with ``gap`` hours of context; the latest start is then carried over bucket borders
    by a scan over one row per station and bucket.
    """
    b = _bucketed(hourly.where(F.col("mm") > F.lit(wet)), gap)
    w = Window.partitionBy("station", "_b").orderBy("_h")
    prev = F.lag("_h").over(w)
    b = b.withColumn("_prev", prev).where("_own")
    starts = b.withColumn("_s", F.when(F.col("_prev").isNull() | (F.col("_h") - F.col("_prev") > gap), F.col("hour")))
    local = starts.withColumn("_local", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tails = starts.groupBy("station", "_b").agg(F.max("_s").alias("_tail"))
    carry = tails.withColumn(
        "_carry",
        F.last("_tail", ignorenulls=True).over(
            Window.partitionBy("station").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ),
    ).drop("_tail")
    return local.join(carry, ["station", "_b"]).select(
        "station", "hour", "mm", F.coalesce("_local", "_carry").alias("event_start")
    )


def rain_events(hourly: DataFrame, gap: int = 6, wet: float = 0.0) -> DataFrame:
    """``(station, event_start, event_end, hours, mm)``, one row per separated event."""
    return event_hours(hourly, gap, wet).groupBy("station", "event_start").agg(
        F.max("hour").alias("event_end"), F.count(F.lit(1)).alias("hours"), F.sum("mm").alias("mm")
    )


def top_events(hourly: DataFrame, n: int = 5, gap: int = 6, hours: Sequence[int] = (3, 24)) -> DataFrame:
    """Per station the ``n`` largest events by their peak rolling sums, then the means of the peaks.

    Events are ranked by the largest ``max(hours)`` sum; earlier start wins a tie.
    """
    sums = rolling_sums(hourly, hours).join(event_hours(hourly, gap).drop("mm"), ["station", "hour"])
    peaks = sums.groupBy("station", "event_start").agg(*[F.max(f"mm_{h}h").alias(f"peak_{h}h") for h in hours])
    # rounding keeps the order independent of the order of addition
    order = Window.partitionBy("station").orderBy(F.round(f"peak_{max(hours)}h", 6).desc(), "event_start")
    best = peaks.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return best.groupBy("station").agg(F.count(F.lit(1)).alias("events"), *[F.avg(f"peak_{h}h").alias(f"mean_peak_{h}h") for h in hours])


def monthly_totals(df: DataFrame, ts: str, value: str | None = None) -> DataFrame:
    """Sum (or count without ``value``) per calendar month, labelled by month end, gaps as 0."""
    measure = F.sum(value) if value else F.count(F.lit(1))
    months = df.groupBy(F.last_day(F.col(ts)).alias("month_end")).agg(measure.alias("total"))
    return month_spine(df, ts).join(months, "month_end", "left").fillna(0, ["total"])


def month_spine(df: DataFrame, ts: str) -> DataFrame:
    """All month ends between the first and last date, from one aggregate row."""
    span = df.agg(F.trunc(F.min(ts), "month").alias("a"), F.trunc(F.max(ts), "month").alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return months.select(F.last_day("m").alias("month_end"))


def monthly_pair(rain: DataFrame, complaints: DataFrame, rain_ts: str, mm: str, complaint_ts: str) -> DataFrame:
    """Monthly rain beside monthly complaint counts over the joint calendar."""
    r = monthly_totals(rain, rain_ts, mm).withColumnRenamed("total", "rain")
    c = monthly_totals(complaints, complaint_ts).withColumnRenamed("total", "complaints")
    return r.join(c, "month_end", "full").fillna(0, ["rain", "complaints"])


def monthly_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.month(ts).alias("month")).agg(F.avg(value).alias("mean_mm"))


def yearly_extremes(df: DataFrame, ts: str, value: str, least: float = 50.0) -> DataFrame:
    return df.where(F.col(value) >= least).groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("extremes"))


def annual_max_mean(hourly: DataFrame, ts: str = "hour") -> DataFrame:
    """Mean over the years of the yearly largest value, per station."""
    yearly = hourly.groupBy("station", F.year(ts).alias("year")).agg(F.max("mm").alias("peak"))
    return yearly.groupBy("station").agg(F.avg("peak").alias("annual_max_mean"), F.count(F.lit(1)).alias("years"))


def hours_over(hourly: DataFrame, least: float = 30.0, ts: str = "hour") -> DataFrame:
    """Hours at or above ``least`` per observed year and station."""
    yearly = hourly.groupBy("station", F.year(ts).alias("year")).agg(
        F.sum(F.when(F.col("mm") >= least, 1).otherwise(0)).alias("n")
    )
    return yearly.groupBy("station").agg((F.sum("n") / F.count(F.lit(1))).alias("hours_per_year"))


def exceed_ratio(annual: DataFrame, design: DataFrame) -> DataFrame:
    """Yearly peak over the design rainfall of the station (``design`` has one row per station)."""
    return annual.join(design, "station").select(
        "station", F.try_divide("annual_max_mean", "design_mm").alias("exceed_ratio")
    )


def long_stations(df: DataFrame, ts: str, least_days: int) -> DataFrame:
    """Stations observed over at least ``least_days`` days."""
    span = df.groupBy("station").agg(F.datediff(F.max(ts), F.min(ts)).alias("days"))
    return span.where(F.col("days") >= least_days)


def rain_before(complaints: DataFrame, hourly: DataFrame, identity: str, ts: str, hours: int = 24) -> DataFrame:
    """Rain of the ``hours`` full hours before each complaint, and the latest wet hour.

    A complaint is listed under the days its look-back touches and meets the at most 24 hourly rows
    of its station and day; the sums combine before they are shuffled.
    """
    start = hour_of(ts)
    first = start - F.make_dt_interval(hours=F.lit(hours))
    last = start - F.make_dt_interval(hours=F.lit(1))
    wanted = complaints.select(F.col(identity), F.col("station"), first.alias("_a"), last.alias("_b")).withColumn(
        "_day", F.explode(F.sequence(F.to_date("_a"), F.to_date("_b"), F.expr("interval 1 day")))
    )
    got = salted_join(wanted, hourly.withColumn("_day", F.to_date("hour")), ["station", "_day"], [identity], "left")
    inside = F.col("hour").between(F.col("_a"), F.col("_b"))
    return got.groupBy(identity).agg(
        F.coalesce(F.sum(F.when(inside, F.col("mm"))), F.lit(0.0)).alias("rain_before"),
        F.max(F.when(inside & (F.col("mm") > 0), F.col("hour"))).alias("last_wet_hour"),
    )


def interval_join(windows: DataFrame, points: DataFrame, key: str, start: str, end: str, ts: str, identity: Sequence[str]) -> DataFrame:
    """Points with the windows of the same key that cover them (both ends included).

    Windows are listed once per day they touch, so the join is an equality on key and day.
    """
    days = windows.withColumn(
        "_day", F.explode(F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day")))
    )
    dated = points.withColumn("_day", F.to_date(ts))
    met = salted_join(dated, days, [key, "_day"], identity)
    return met.where(F.col(ts).between(F.col(start), F.col(end))).drop("_day")


def lag_response(rain: DataFrame, level: DataFrame, lags: int = 24) -> DataFrame:
    """Correlation of rain with the level ``lag`` hours later: ``(lag, n, r)``.

    Both inputs are hourly ``(station, hour, value)``; every rain hour is listed once per lag and
    meets the level by equality.
    """
    shifted = rain.select(
        "station", F.col("hour").alias("_h"), F.col("mm"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")
    ).withColumn("hour", F.col("_h") + F.make_dt_interval(hours=F.col("lag")))
    met = shifted.join(level.select("station", "hour", "level"), ["station", "hour"])
    return met.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), pearson("mm", "level").alias("r"))
