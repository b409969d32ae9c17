"""Rain and river series."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.operators import ordering, rain
from rillgrid.plans.joins_queries import _EVENTS
from rillgrid.plans.registry import R, query


@query(
    "ag9_monthly_sum",
    f"""WITH s AS (SELECT last_day(unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM rain_years), (SELECT max(ts) FROM rain_years), INTERVAL 1 MONTH))) AS month_end)
        SELECT CAST(CAST(s.month_end AS DATE) AS VARCHAR) AS month_end, {R('coalesce(sum(r.mm), 0)')} AS total FROM s LEFT JOIN rain_years r ON last_day(r.ts) = s.month_end GROUP BY 1""",
)
def _(r):
    return rain.monthly_totals(r.rain_years, "ts", "mm").withColumn("month_end", F.col("month_end").cast("string"))


@query("ag9_monthly_count", "SELECT CAST(CAST(last_day(o_orderdate) AS DATE) AS VARCHAR) AS month_end, count(*) AS total FROM orders GROUP BY 1")
def _(r):
    return rain.monthly_totals(r.table("orders"), "o_orderdate").withColumn("month_end", F.col("month_end").cast("string"))


@query("ag10_monthly_mean_rain", f"SELECT CAST(month(ts) AS INTEGER) AS month, {R('avg(mm)')} AS mean_mm FROM rain_years GROUP BY 1")
def _(r):
    return rain.monthly_mean(r.rain_years, "ts", "mm")


@query("ag10_yearly_extremes", "SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS extremes FROM rain_years WHERE mm >= 50 GROUP BY 1")
def _(r):
    return rain.yearly_extremes(r.rain_years, "ts", "mm", 50)


_DAILY = "WITH d AS (SELECT station, date_trunc('day', ts) AS hour, sum(mm) AS mm FROM rain_years GROUP BY 1, 2)"
_PEAKS = f"{_DAILY}, y AS (SELECT station, year(hour) AS year, max(mm) AS peak FROM d GROUP BY 1, 2), m AS (SELECT station, avg(peak) AS annual_max_mean, count(*) AS years FROM y GROUP BY 1)"


def _daily(r):
    return rain.hourly_sum(r.rain_years)


@query("ag11_annual_max_mean", f"{_PEAKS} SELECT station, {R('annual_max_mean')} AS annual_max_mean, years FROM m")
def _(r):
    return rain.annual_max_mean(_daily(r))


@query(
    "ag12_hours_over",
    f"{_DAILY} SELECT station, {R('count(*) FILTER (WHERE mm >= 30) * 1.0 / count(DISTINCT year(hour))')} AS hours_per_year FROM d GROUP BY 1",
)
def _(r):
    return rain.hours_over(_daily(r), 30)


@query("ag13_exceed_ratio", f"{_PEAKS} SELECT m.station, {R('annual_max_mean / (60 + m.station % 20)')} AS exceed_ratio FROM m JOIN supplier ON s_suppkey = m.station")
def _(r):
    design = r.table("supplier").select(F.col("s_suppkey").alias("station"), (F.lit(60.0) + F.col("s_suppkey") % 20).alias("design_mm"))
    return rain.exceed_ratio(rain.annual_max_mean(_daily(r)), design)


@query(
    "ag14_minute_to_hour",
    f"""SELECT station, hour, {R('mm')} AS mm, 'aws' AS src FROM hourly
        UNION ALL SELECT station, date_trunc('hour', ts), {R('sum(mm)')}, 'city' FROM rain_years GROUP BY 1, 2""",
)
def _(r):
    aws = rain.hourly_sum(r.rain).withColumn("src", F.lit("aws"))
    return rain.merge_networks(aws, rain.hourly_sum(r.rain_years).withColumn("src", F.lit("city")))


@query(
    "ag15_long_stations",
    """SELECT station, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS days FROM rain_years GROUP BY 1
       HAVING date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) >= 5 * 365""",
)
def _(r):
    return rain.long_stations(r.rain_years, "ts", 5 * 365)


@query(
    "ag16_hourly_quantile",
    f"SELECT station, {R('quantile_cont(mm, 0.95)')} AS q95 FROM hourly GROUP BY 1",
)
def _(r):
    return ordering.quantiles(rain.hourly_sum(r.rain), ["mm"], [0.95], by=["station"]).select("station", F.col("q").alias("q95"))


@query(
    "ag29_lag_response",
    f"""WITH lv AS (SELECT station, hour, mm * 0.5 + day(hour) AS level FROM hourly), k AS (SELECT unnest(range(25)) AS lag)
        SELECT CAST(k.lag AS INTEGER) AS lag, count(*) AS n, {R('corr(h.mm, lv.level)')} AS r FROM hourly h CROSS JOIN k
        JOIN lv ON lv.station = h.station AND lv.hour = h.hour + to_hours(CAST(k.lag AS INTEGER)) GROUP BY 1""",
)
def _(r):
    hourly = rain.hourly_sum(r.rain)
    level = hourly.select("station", "hour", (F.col("mm") * 0.5 + F.day("hour")).alias("level"))
    return rain.lag_response(hourly, level, 24)


@query(
    "ag29_best_lag",
    f"""WITH lv AS (SELECT station, hour, mm * 0.5 + day(hour) AS level FROM hourly), k AS (SELECT unnest(range(25)) AS lag),
        c AS (SELECT CAST(k.lag AS INTEGER) AS lag, corr(h.mm, lv.level) AS r FROM hourly h CROSS JOIN k
        JOIN lv ON lv.station = h.station AND lv.hour = h.hour + to_hours(CAST(k.lag AS INTEGER)) GROUP BY 1)
        SELECT lag AS best_lag, {R('r')} AS r FROM c ORDER BY r DESC LIMIT 1""",
)
def _(r):
    hourly = rain.hourly_sum(r.rain)
    level = hourly.select("station", "hour", (F.col("mm") * 0.5 + F.day("hour")).alias("level"))
    return rain.lag_response(hourly, level, 24).agg(F.max_by("lag", "r").alias("best_lag"), F.max("r").alias("r"))


@query(
    "wn1_rolling_sums",
    f"""SELECT station, hour, {R('mm')} AS mm,
        {R("sum(mm) OVER (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)")} AS mm_3h,
        {R("sum(mm) OVER (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)")} AS mm_24h FROM hourly""",
)
def _(r):
    return rain.rolling_sums(rain.hourly_sum(r.rain), (3, 24))


@query(
    "wn2_top_events",
    f"""{_EVENTS}, roll AS (SELECT station, hour,
          sum(mm) OVER (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS m3,
          sum(mm) OVER (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS m24 FROM hourly),
        peaks AS (SELECT e.station, e.event_start, max(m3) AS p3, max(m24) AS p24 FROM spells e JOIN roll ON roll.station = e.station
          AND roll.hour BETWEEN e.event_start AND e.event_end GROUP BY 1, 2),
        best AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(p24, 6) DESC, event_start) AS rn FROM peaks)
        SELECT station, count(*) AS events, {R('avg(p3)')} AS mean_peak_3h, {R('avg(p24)')} AS mean_peak_24h FROM best WHERE rn <= 5 GROUP BY 1""",
)
def _(r):
    return rain.top_events(rain.hourly_sum(r.rain), 5, 6)


@query("wn3_event_sessions", f"{_EVENTS} SELECT station, event_start, event_end, hours, {R('mm')} AS mm FROM spells")
def _(r):
    return rain.rain_events(rain.hourly_sum(r.rain), 6)
