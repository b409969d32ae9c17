"""The domain tables as views over the test tables.

Places repeat in towns of 4 x 4 km (40 x 40 cells) laid side by side, and every town holds a fixed
number of keys: more data means more towns, not denser ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.sources.catalog import load_dataset

TOWN = 4000
PER_TOWN = {"supplier": 100, "customer": 1500, "orderkey": 15000, "event": 10000}


def _place(key: str, per_town: int) -> tuple[Column, Column]:
    k = F.col(key)
    x = (k * 7919) % TOWN + F.floor(k / per_town) * TOWN
    y = (k * 1237 + F.floor(k / 40)) % TOWN
    return x.alias("x"), y.alias("y")


def _district() -> Column:
    """Blocks of 800 m, 25 per town."""
    return (F.floor(F.col("x") / 800) * 5 + F.floor(F.col("y") / 800)).alias("dong")


class Roles:
    """Lazily built views; attribute access to a table name loads that table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load_dataset(self.spark, self.folder, name)

    @property
    def site(self) -> DataFrame:
        """Stations, pumps and shelters."""
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").alias("site_id"), *_place("s_suppkey", PER_TOWN["supplier"]), F.col("s_acctbal").alias("value")).select(
            "*", _district()
        )

    @property
    def household(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("hh_id"), *_place("c_custkey", PER_TOWN["customer"]),
            (F.col("c_mktsegment") == "HOUSEHOLD").alias("elderly"), (F.col("c_mktsegment") == "MACHINERY").alias("single"),
            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        ).select("*", _district())

    @property
    def building(self) -> DataFrame:
        o = self.table("orders")
        year = F.year("o_orderdate")
        return o.select(
            F.col("o_orderkey").alias("bld_id"), year.alias("approval_year"), (F.lit(2026) - year).alias("age"),
            *_place("o_custkey", PER_TOWN["customer"]), F.col("o_totalprice").alias("floor_area"),
            (F.col("o_orderpriority") == "1-URGENT").alias("basement"), F.col("o_orderdate").alias("approved"),
        ).select("*", _district())

    @property
    def pipe(self) -> DataFrame:
        li = self.table("lineitem")
        year = F.year("l_shipdate")
        x = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131) % TOWN + F.floor(F.col("l_orderkey") / PER_TOWN["orderkey"]) * TOWN
        y = (F.col("l_orderkey") * 1237 + F.col("l_linenumber") * 977) % TOWN
        return li.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
            year.alias("laid_year"), (F.lit(2026) - year).alias("age"), F.col("l_quantity").alias("length"),
            (F.col("l_partkey") % 50 + 1).alias("diameter"), F.col("l_returnflag").alias("material"),
            (F.col("l_linestatus") == "F").alias("combined"), x.alias("x"), y.alias("y"),
        ).select("*", _district())

    @property
    def rain(self) -> DataFrame:
        """Readings of one month; a station has three senders."""
        e = self.table("events")
        return e.select("event_id", F.floor(F.col("user_id") / 3).alias("station"), "ts", (F.col("value") / 5).alias("mm"))

    @property
    def rain_years(self) -> DataFrame:
        """Daily readings of seven years."""
        li = self.table("lineitem")
        return li.select(F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("mm"))

    @property
    def complaint(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("c_id"), F.col("event_type").alias("type"), "ts", *_place("event_id", PER_TOWN["event"]),
            F.floor(F.col("user_id") / 3).alias("station"), (F.col("value") / 5).alias("mm"),
        ).select("*", _district())

    def _pixels(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").where((k * 7 + F.floor(k / 120) * 3) % 19 != 5)

    @property
    def dem(self) -> DataFrame:
        """Columns of 120 pixels, one pixel per order, tilted so that inner pixels drain; one in nineteen is missing."""
        o = self._pixels()
        row, col = F.col("o_orderkey") % 120, F.floor(F.col("o_orderkey") / 120)
        return o.select(row.alias("row"), col.alias("col"), (row * 3 + col * 2 + F.col("o_custkey") % 3).cast("double").alias("z"))

    @property
    def rough_dem(self) -> DataFrame:
        """The same raster with pits everywhere."""
        o = self._pixels()
        row, col = F.col("o_orderkey") % 120, F.floor(F.col("o_orderkey") / 120)
        return o.select(row.alias("row"), col.alias("col"), (F.lit(50) + F.col("o_custkey") % 40).cast("double").alias("z"))

    @property
    def diamond(self) -> DataFrame:
        """One diamond ring per site: half diagonal 60 to 260 m."""
        h = F.lit(60) + F.col("site_id") % 5 * 50
        pt = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
        return self.site.withColumn("h", h).select(
            F.col("site_id").alias("poly_id"), F.array(pt(F.col("h"), 0), pt(0, F.col("h")), pt(-F.col("h"), 0), pt(0, -F.col("h"))).alias("ring"),
            (F.col("site_id") % 6).alias("depth_no"), F.when(F.col("site_id") % 7 == 0, "710").when(F.col("site_id") % 2 == 0, "110").otherwise("310").alias("cover"),
        )

    @property
    def grid(self) -> DataFrame:
        """All cells over the pipes."""
        from rillgrid.operators.spatial import grid_over

        return grid_over(self.pipe).select("grid_id", "i", "j")

    @property
    def segment(self) -> DataFrame:
        """River pieces: a site to a point 200-400 m away."""
        s = self.site
        return s.select(
            F.col("site_id").alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"),
            (F.col("x") + 200 + F.col("site_id") % 200).alias("x2"), (F.col("y") + F.col("site_id") % 300 - 150).alias("y2"),
        )


# The same views in SQL, for the check by another engine.
ROLE_SQL = {
    "site": """SELECT *, (x // 800) * 5 + y // 800 AS dong FROM (
        SELECT s_suppkey AS site_id, (s_suppkey * 7919) % 4000 + (s_suppkey // 100) * 4000 AS x,
               (s_suppkey * 1237 + s_suppkey // 40) % 4000 AS y, s_acctbal AS value FROM supplier)""",
    "household": """SELECT *, (x // 800) * 5 + y // 800 AS dong FROM (
        SELECT c_custkey AS hh_id, (c_custkey * 7919) % 4000 + (c_custkey // 1500) * 4000 AS x,
               (c_custkey * 1237 + c_custkey // 40) % 4000 AS y, c_mktsegment = 'HOUSEHOLD' AS elderly,
               c_mktsegment = 'MACHINERY' AS single, c_acctbal AS balance, c_mktsegment AS segment FROM customer)""",
    "building": """SELECT *, (x // 800) * 5 + y // 800 AS dong FROM (
        SELECT o_orderkey AS bld_id, year(o_orderdate) AS approval_year, 2026 - year(o_orderdate) AS age,
               (o_custkey * 7919) % 4000 + (o_custkey // 1500) * 4000 AS x, (o_custkey * 1237 + o_custkey // 40) % 4000 AS y,
               o_totalprice AS floor_area, o_orderpriority = '1-URGENT' AS basement, o_orderdate AS approved FROM orders)""",
    "pipe": """SELECT *, (x // 800) * 5 + y // 800 AS dong FROM (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, year(l_shipdate) AS laid_year,
               2026 - year(l_shipdate) AS age, l_quantity AS length, l_partkey % 50 + 1 AS diameter, l_returnflag AS material,
               l_linestatus = 'F' AS combined, (l_orderkey * 7919 + l_linenumber * 131) % 4000 + (l_orderkey // 15000) * 4000 AS x,
               (l_orderkey * 1237 + l_linenumber * 977) % 4000 AS y FROM lineitem)""",
    "rain": "SELECT event_id, user_id // 3 AS station, ts, value / 5 AS mm FROM events",
    "rain_years": "SELECT l_suppkey AS station, l_shipdate AS ts, l_quantity AS mm FROM lineitem",
    "complaint": """SELECT *, (x // 800) * 5 + y // 800 AS dong FROM (
        SELECT event_id AS c_id, event_type AS type, ts, (event_id * 7919) % 4000 + (event_id // 10000) * 4000 AS x,
               (event_id * 1237 + event_id // 40) % 4000 AS y, user_id // 3 AS station, value / 5 AS mm FROM events)""",
    "dem": """SELECT o_orderkey % 120 AS row, o_orderkey // 120 AS col,
        CAST((o_orderkey % 120) * 3 + (o_orderkey // 120) * 2 + o_custkey % 3 AS DOUBLE) AS z FROM orders
        WHERE (o_orderkey * 7 + o_orderkey // 120 * 3) % 19 <> 5""",
    "rough_dem": """SELECT o_orderkey % 120 AS row, o_orderkey // 120 AS col, CAST(50 + o_custkey % 40 AS DOUBLE) AS z FROM orders
        WHERE (o_orderkey * 7 + o_orderkey // 120 * 3) % 19 <> 5""",
    "diamond": """SELECT site_id AS poly_id, x, y, 60 + site_id % 5 * 50 AS h, site_id % 6 AS depth_no,
        CASE WHEN site_id % 7 = 0 THEN '710' WHEN site_id % 2 = 0 THEN '110' ELSE '310' END AS cover FROM site""",
    "segment": """SELECT site_id AS seg_id, x AS x1, y AS y1, x + 200 + site_id % 200 AS x2, y + site_id % 300 - 150 AS y2 FROM site""",
    "grid": """SELECT a.i, b.j, concat(a.i * 100, '_', b.j * 100) AS grid_id FROM
        (SELECT unnest(range(min(x) // 100, max(x) // 100 + 1)) AS i FROM pipe) a,
        (SELECT unnest(range(min(y) // 100, max(y) // 100 + 1)) AS j FROM pipe) b""",
    "hourly": "SELECT station, date_trunc('hour', ts) AS hour, sum(mm) AS mm FROM rain GROUP BY 1, 2",
}
