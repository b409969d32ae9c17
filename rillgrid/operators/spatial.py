"""Spatial joins on integer bins: every distance or containment test is an equi-join first."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillgrid.functions.geo import CELL, cell_id, cell_index, distance
from rillgrid.skew import heavy_keys, salted_join
from rillgrid.staging import settle


def with_cell(df: DataFrame, x: str = "x", y: str = "y", size: float = CELL) -> DataFrame:
    return df.withColumns({"i": cell_index(x, size), "j": cell_index(y, size)})


def make_grid(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, size: int = CELL) -> DataFrame:
    """All cells of a bounding box, counted in integers so no row or column is gained or lost."""
    i0, j0 = math.floor(min_x / size), math.floor(min_y / size)
    nx, ny = math.ceil(max_x / size) - i0, math.ceil(max_y / size) - j0
    k = F.col("id")
    return spark.range(nx * ny).select(
        cell_id(F.lit(i0) + F.floor(k / ny), F.lit(j0) + k % ny, size).alias("grid_id"),
        (F.lit(i0) + F.floor(k / ny)).cast("long").alias("i"),
        (F.lit(j0) + k % ny).cast("long").alias("j"),
        k.alias("seq"),
    )


def grid_over(points: DataFrame, x: str = "x", y: str = "y", size: int = CELL) -> DataFrame:
    """Grid over the bounding box of a point table (one aggregate row decides the extent)."""
    b = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    top = [math.floor(v / size) * size + size for v in (b[2], b[3])]
    return make_grid(points.sparkSession, float(b[0]), float(b[1]), top[0], top[1], size)


def point_in_cell(grid: DataFrame, points: DataFrame, identity: Sequence[str], size: float = CELL) -> DataFrame:
    """Grid with its points; cells without points keep one row of nulls.

    The join runs from the point side so that crowded cells can be split; the empty cells are
    added by an anti-join with the distinct occupied cells.
    """
    located = with_cell(points, size=size)
    inside = salted_join(located, grid, ["i", "j"], identity)
    empty = grid.join(located.select("i", "j").distinct(), ["i", "j"], "left_anti")
    return inside.unionByName(empty, allowMissingColumns=True)


def attach(grid: DataFrame, *layers: DataFrame, on: Sequence[str] = ("i", "j")) -> DataFrame:
    """Left-join layers that are already aggregated to one row per cell."""
    out = grid
    for layer in layers:
        out = out.join(layer, list(on), "left")
    return out


# -- polygons ---------------------------------------------------------------------------------


def ring_edges(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """Closed ring (array of x,y structs, first point not repeated) to directed edges."""
    pts = F.col(ring)
    nxt = F.concat(F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    return rings.select(key, F.explode(F.arrays_zip(pts.alias("a"), nxt.alias("b"))).alias("e")).select(
        key,
        F.col("e.a.x").cast("double").alias("x1"),
        F.col("e.a.y").cast("double").alias("y1"),
        F.col("e.b.x").cast("double").alias("x2"),
        F.col("e.b.y").cast("double").alias("y2"),
    )


EDGES = 64  # edges that a row of the index holds on average at most


def _at(h):
    """Where an edge meets the height ``h``, kept between its ends whatever rounding does."""
    x = F.col("x1") + (h - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1")).otherwise(1.0)
    return F.greatest(F.least(x, F.greatest("x1", "x2")), F.least("x1", "x2"))


def polygon_cover(edges: DataFrame, key: str, size: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Index of polygons by cell: the cells wholly inside, ``(i, j, key)``, and the cells on borders, ``(i, j, key, chunks, base, edges)``.

    A border cell lists only the edges that pass through it, in ``chunks`` rows of some ``EDGES`` each, so no row grows with an outline.
    A path leads from a point to the right side of its cell, up that side, and on to the right from the upper corner.  What its last
    part crosses is counted once per cell, by a sum along the row of cells; ``base`` is that count without the edges listed for the cell.
    """
    pad = size * 1e-6  # an edge along a border counts for the cells on both sides; edges too many change nothing
    top, right = (F.col("j") + 1) * F.lit(float(size)), (F.col("i") + 1) * F.lit(float(size))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("j", F.explode(F.sequence(cell_index(low - pad, size), cell_index(high + pad, size))))
    ends = [_at(F.greatest(low, F.col("j") * F.lit(float(size)) - pad)), _at(F.least(high, top + pad))]
    flat = F.col("y1") == F.col("y2")
    lo, hi = F.when(flat, F.least("x1", "x2")).otherwise(F.least(*ends)), F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(*ends))
    over = (F.col("y1") > top) != (F.col("y2") > top)
    listed = banded.withColumn("i", F.explode(F.sequence(cell_index(lo - pad, size), cell_index(hi + pad, size)))).withColumn("r", (over & (right < _at(top))).cast("long"))
    # the last cell whose right side an edge passes on the right at the top of its row
    met = banded.where(over).select(key, "j", _at(top).alias("at")).withColumn("i", F.ceil(F.col("at") / size) - 2)
    met = met.withColumn("i", F.when((F.col("i") + 2) * F.lit(float(size)) < F.col("at"), F.col("i") + 1).when(right < F.col("at"), F.col("i")).otherwise(F.col("i") - 1))
    cells = listed.groupBy(key, "j", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"))
    steps = met.groupBy(key, "j", "i").agg(F.count(F.lit(1)).alias("t"))
    rows = cells.unionByName(steps, allowMissingColumns=True).groupBy(key, "j", "i").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "r", "t")])
    along = Window.partitionBy(key, "j").orderBy(F.desc("i"))
    rows = rows.withColumns({"beyond": F.sum("t").over(along.rowsBetween(Window.unboundedPreceding, 0)), "lower": F.lead("i").over(along)})
    first = F.coalesce(F.col("lower") + 1, F.col("i"))
    last = F.when(F.col("n") > 0, F.col("i") - 1).otherwise(F.col("i"))
    inner = rows.where((F.col("beyond") % 2 == 1) & (first <= last)).select(F.explode(F.sequence(first, last)).alias("i"), "j", key)
    border = rows.where("n > 0").select(key, "j", "i", F.ceil(F.col("n") / EDGES).alias("chunks"), ((F.col("beyond") + F.col("r")) % 2).alias("base"))
    chunk = F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), F.col("chunks"))
    sides = listed.join(border, [key, "j", "i"]).groupBy("i", "j", key, "chunks", "base", chunk.alias("chunk"))
    return inner, sides.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


def _passed(x, y, size: float):
    """How often the path from (x, y) to the upper right corner of its cell passes the ``edges``, but for a count that is the same for the whole cell."""
    right, top = (F.col("i") + 1) * F.lit(float(size)), (F.col("j") + 1) * F.lit(float(size))

    def step(acc, e):
        at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y1"] != e["y2"], e["y2"] - e["y1"]).otherwise(1.0)
        at = F.greatest(F.least(at, F.greatest(e["x1"], e["x2"])), F.least(e["x1"], e["x2"]))
        ahead = ((e["y1"] > y) != (e["y2"] > y)) & (x < at)
        beside = [(e["x" + k] > right) & (e["y" + k] > y) & (e["y" + k] <= top) for k in "12"]
        return acc + ahead.cast("long") + beside[0].cast("long") + beside[1].cast("long")

    return F.aggregate("edges", F.lit(0).cast("long"), step)


def point_in_polygon(points: DataFrame, edges: DataFrame, key: str, identity: Sequence[str], size: float = CELL) -> DataFrame:
    """Pairs of points and the polygons that contain them (holes are further rings); repeated points give repeated pairs.

    Points in cells wholly inside need no test; in border cells they are held against the edges of the cell.  Where these
    take several rows of the index, the counts of the rows are added up by point.
    """
    located = with_cell(points, size=size)
    inner, border = polygon_cover(edges.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL"), key, size)
    # inside a cell that is wholly inside, the path passes an odd number of edges elsewhere and none here
    without = inner.withColumns({"chunks": F.lit(1).cast("long"), "chunk": F.lit(0).cast("long"), "base": F.lit(1).cast("long")})
    index = settle(border.unionByName(without, allowMissingColumns=True), "cover")
    heavy = heavy_keys(located, ["i", "j"])
    passed = F.coalesce(_passed(F.col("x").cast("double"), F.col("y").cast("double"), size), F.lit(0))
    wanted = [*[c for c in points.columns if c not in ("i", "j")], key]
    met = lambda part: salted_join(located, index.where(part), ["i", "j"], identity, heavy=heavy, rows=0).withColumn("passed", passed)
    odd = (F.col("base") + F.col("passed")) % 2 == 1
    out = met("chunks = 1").where(odd).select(*wanted)
    if index.where("chunks > 1").isEmpty():
        return out
    copies = F.count(F.lit(1)) / F.countDistinct("chunk")
    added = met("chunks > 1").groupBy(*wanted, "base").agg((F.sum("passed") / copies).cast("long").alias("passed"), copies.cast("int").alias("copies"))
    return out.unionByName(added.where(odd).select(*wanted, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*wanted))


def _signed_edges(rings: DataFrame, keys: list[str], hole: str | None) -> DataFrame:
    """Edges (k, x1, y1, x2, y2, sign) of closed rings, with their keys in ``k``; ``sign`` makes the area of an outline positive and that of a hole negative."""
    pts = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    nxt = F.concat(F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    sides = F.arrays_zip(pts.alias("a"), nxt.alias("b"))
    # the first corner as origin, as coordinates are large beside the ring; it goes along in the state, where it is evaluated once
    start = F.struct(F.lit(0.0).alias("s"), F.get("sides", F.lit(0))["a"]["y"].alias("y"))
    add = lambda s, e: F.struct((s["s"] + (e["a"]["x"] - e["b"]["x"]) * (e["a"]["y"] + e["b"]["y"] - 2 * s["y"])).alias("s"), s["y"].alias("y"))
    turn = F.aggregate("sides", start, add, lambda s: s["s"])
    wanted = F.lit(1.0) if hole is None else F.when(F.coalesce(F.col(hole), F.lit(False)), -1.0).otherwise(1.0)
    signed = rings.where(F.size("ring") > 2).select(F.struct(*keys).alias("k"), wanted.alias("wanted"), sides.alias("sides")).withColumn("sign", F.signum(turn) * F.col("wanted"))
    each = signed.select("k", "sign", F.explode("sides").alias("e")).where("sign <> 0")
    return each.select("k", "sign", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def cell_polygon_overlap(rings: DataFrame, key: str | Sequence[str], size: int = CELL, hole: str | None = None) -> DataFrame:
    """``(i, j, key, area)`` for every cell that the polygon of a ``key`` overlaps.

    A polygon is all rings of its key: any number of parts, which do not overlap, and of holes, which the boolean column ``hole`` marks;
    the direction of a ring does not matter.  ``key`` may name further columns that go with a polygon.  Each edge is cut at cell borders.
    A piece adds, with its sign, the area between itself and the right side of its cell, and its height counts in full for all
    cells to the right; a prefix sum along the row of cells gives the rest.  So rings are never copied to cells, the edges of one
    polygon spread over many tasks, and a task sums one row of cells, with a row of input per cell that an edge touches.

    Rings of fewer than three corners or without area are ignored.
    """
    keys = [key] if isinstance(key, str) else list(key)
    s, tiny = F.lit(float(size)), 1e-9 * size * size
    edges = _signed_edges(rings, keys, hole).where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("j", F.explode(F.sequence(cell_index(low, size), cell_index(high, size))))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    bottom, top = F.greatest(low, F.col("j") * s), F.least(high, (F.col("j") + 1) * s)
    up = F.when(F.col("y2") > F.col("y1"), -F.col("sign")).otherwise(F.col("sign"))  # the inside lies to the right of edges that go down
    # exact ends where the edge itself ends
    end = lambda y: F.when(y == F.col("y1"), F.col("x1")).when(y == F.col("y2"), F.col("x2")).otherwise(at(y))
    pieces = rows.select("k", "j", up.alias("up"), bottom.alias("bottom"), top.alias("top"), end(bottom).alias("xa"), end(top).alias("xb")).where("top > bottom")
    left, right = F.least("xa", "xb"), F.greatest("xa", "xb")
    cells = pieces.withColumn("i", F.explode(F.sequence(cell_index(left, size), cell_index(right, size))))
    from_, to = F.greatest(left, F.col("i") * s), F.least(right, (F.col("i") + 1) * s)
    part = F.when(right > left, (to - from_) / (right - left)).otherwise(1.0)
    height = (F.col("top") - F.col("bottom")) * part * F.col("up")
    cells = cells.select("k", "i", "j", height.alias("height"), (height * ((F.col("i") + 1) * s - (from_ + to) / 2)).alias("own"))
    sums = cells.groupBy("k", "i", "j").agg(F.sum("height").alias("height"), F.sum("own").alias("own"))
    along = Window.partitionBy("k", "j").orderBy("i")
    carried = sums.select(
        "k", "i", "j", "own", "height", F.lead("i").over(along).alias("next"), F.coalesce(F.sum("height").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cover"),
    )
    inside = (F.col("cover") + F.col("height")) * s
    between = F.when((F.col("next") > F.col("i") + 1) & (inside > tiny), F.sequence(F.col("i") + 1, F.col("next") - 1)).otherwise(F.array().cast("array<bigint>"))
    found = F.concat(
        F.array(F.struct(F.col("i").alias("i"), (F.col("own") + F.col("cover") * s).alias("area"))), F.transform(between, lambda i: F.struct(i.alias("i"), inside.alias("area"))),
    )
    return carried.select("k", "j", F.explode(found).alias("c")).select("c.i", "j", "k.*", "c.area").where(F.col("area") > tiny)


# -- distances --------------------------------------------------------------------------------


def _neighbour_bins(df: DataFrame, reach: int = 1) -> DataFrame:
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        df.withColumn("_di", F.explode(steps))
        .withColumn("_dj", F.explode(steps))
        .withColumns({"bi": F.col("bi") + F.col("_di"), "bj": F.col("bj") + F.col("_dj")})
        .drop("_di", "_dj")
    )


def _bins(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"bi": cell_index(x, size), "bj": cell_index(y, size)})


PAIRS_PER_ROW = 256  # candidate pairs per input row that the bin join may form
LEAF = 32  # sites of a tree node that need no further split
SPLIT = 4  # a tree node has SPLIT x SPLIT children
DEPTH = 12


def k_nearest(
    targets: DataFrame,
    sites: DataFrame,
    target_key: str,
    site_key: str,
    k: int = 1,
    max_radius: float | None = None,
    exclude_self: bool = False,
    pairs_per_row: int = PAIRS_PER_ROW,
) -> DataFrame:
    """The ``k`` nearest sites of every target, ties broken by site key: ``(target, site, d, rn)``.

    Sites at one location are first reduced to the few that can matter.  Then rounds of bin joins:
    with bins as wide as the radius the 3 x 3 bins around a target cover the whole disc, so a target
    with ``k`` sites within the radius is finished and the others go on with twice the radius.  The
    first radius follows the site density.  Before each round the number of pairs it would form is
    taken from bin counts; where sites crowd together and that number is out of proportion, the
    open targets descend a tree of site counts instead.
    """
    want = k + 1 if exclude_self else k
    spot = Window.partitionBy("_sx", "_sy").orderBy(site_key)
    places = (
        sites.select(F.col(site_key), F.col("x").cast("double").alias("_sx"), F.col("y").cast("double").alias("_sy"))
        .withColumn("_rn", F.row_number().over(spot)).where(F.col("_rn") <= want).drop("_rn")
    )
    places = settle(places, "places")
    open_targets = settle(
        targets.select(F.col(target_key), F.col("x").cast("double").alias("_tx"), F.col("y").cast("double").alias("_ty")), "targets"
    )
    box = lambda df, x, y: df.agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    ).first()
    s, t = box(places, "_sx", "_sy"), box(open_targets, "_tx", "_ty")
    if not s["n"] or not t["n"]:
        fields = [places.schema[site_key], *T.StructType.fromDDL("d double, rn int")]
        return sites.sparkSession.createDataFrame([], T.StructType([targets.schema[target_key], *fields]))
    limit = math.hypot(max(s["x1"], t["x1"]) - min(s["x0"], t["x0"]) + 1.0, max(s["y1"], t["y1"]) - min(s["y0"], t["y0"]) + 1.0)
    if max_radius is not None:
        limit = min(limit, float(max_radius))
    area = (s["x1"] - s["x0"] + 1.0) * (s["y1"] - s["y0"] + 1.0)
    radius = min(limit, 1.5 * math.sqrt(area * (want + 1) / (math.pi * s["n"])))
    order = Window.partitionBy(target_key).orderBy("d", site_key)
    done: list[DataFrame] = []
    left = t["n"]
    while left:
        site_bins = _bins(places, "_sx", "_sy", radius)
        target_bins = _neighbour_bins(_bins(open_targets, "_tx", "_ty", radius))
        if _pair_count(site_bins, target_bins) > pairs_per_row * (s["n"] + left):
            done.append(_tree_nearest(open_targets, places, target_key, site_key, want, limit, (s["x0"], s["y0"]), max(s["x1"] - s["x0"], s["y1"] - s["y0"])))
            break
        many, few, identity = (site_bins, target_bins, site_key) if s["n"] >= 9 * left else (target_bins, site_bins, target_key)
        near = salted_join(many, few, ["bi", "bj"], [identity], rows=max(s["n"], 9 * left)).withColumn("d", distance("_sx", "_sy", "_tx", "_ty"))
        best = near.where(F.col("d") <= F.lit(radius)).select(target_key, site_key, "d", F.row_number().over(order).alias("rn"))
        best = best.where(F.col("rn") <= want)
        if radius >= limit:
            done.append(best)
            break
        best = settle(best, "near")
        finished = best.where(F.col("rn") == want).select(target_key)
        done.append(best.join(finished, target_key, "left_semi"))
        open_targets = settle(open_targets.join(finished, target_key, "left_anti"), "open")
        left = open_targets.count()
        radius = min(limit, radius * 2)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    if exclude_self:
        out = out.where(F.col(site_key) != F.col(target_key)).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    return out


def _pair_count(sites: DataFrame, targets: DataFrame) -> int:
    """Pairs that an equi-join on bins would form, from the bin counts alone."""
    a = sites.groupBy("bi", "bj").agg(F.count(F.lit(1)).cast("double").alias("a"))
    b = targets.groupBy("bi", "bj").agg(F.count(F.lit(1)).cast("double").alias("b"))
    return a.join(b, ["bi", "bj"]).agg(F.sum(F.col("a") * F.col("b")).alias("n")).first()["n"] or 0


def _tree_nearest(targets: DataFrame, places: DataFrame, target_key: str, site_key: str, k: int, limit: float,
                  origin: tuple[float, float], extent: float) -> DataFrame:
    """k nearest by descending a tree of site counts, for sites that crowd together.

    A target starts at the root.  Each round replaces the crowded nodes of a target by their
    children; the largest distance of the nearest nodes that hold ``k`` sites together bounds the
    k-th distance, and nodes that begin beyond it are dropped.  So a target carries a handful of
    nodes however the sites are spread, and meets sites only in the few small nodes left.
    """
    side = extent * (1 + 1e-9) + 1e-6
    x0, y0 = origin
    index = lambda c, lo, level: F.floor((F.col(c) - F.lit(lo)) / F.lit(side / SPLIT**level)).cast("long")
    total = places.count()
    state = targets.select("*", F.lit(0).alias("level"), F.lit(0).cast("long").alias("ni"), F.lit(0).cast("long").alias("nj"), F.lit(total).cast("long").alias("cnt"))
    level = 0
    while level < DEPTH and not state.where((F.col("cnt") > LEAF) & (F.col("level") == level)).isEmpty():
        child = places.groupBy(index("_sx", x0, level + 1).alias("ci"), index("_sy", y0, level + 1).alias("cj")).agg(F.count(F.lit(1)).alias("_c"))
        child = child.select(F.floor(F.col("ci") / SPLIT).cast("long").alias("ni"), F.floor(F.col("cj") / SPLIT).cast("long").alias("nj"), "ci", "cj", "_c")
        crowded = (F.col("cnt") > LEAF) & (F.col("level") == level)
        grown = salted_join(state.where(crowded), child, ["ni", "nj"], [target_key]).select(
            target_key, "_tx", "_ty", F.lit(level + 1).alias("level"), F.col("ci").alias("ni"), F.col("cj").alias("nj"), F.col("_c").alias("cnt")
        )
        nodes = grown.unionByName(state.where(~crowded))
        width = F.lit(side) / F.pow(F.lit(float(SPLIT)), F.col("level"))
        lo_x, lo_y = F.lit(x0) + F.col("ni") * width, F.lit(y0) + F.col("nj") * width
        gap = lambda p, lo: F.greatest(lo - F.col(p), F.col(p) - lo - width, F.lit(0.0))
        span = lambda p, lo: F.greatest(F.abs(F.col(p) - lo), F.abs(F.col(p) - lo - width))
        nodes = nodes.withColumns(
            {"_min": F.sqrt(gap("_tx", lo_x) ** 2 + gap("_ty", lo_y) ** 2), "_max": F.sqrt(span("_tx", lo_x) ** 2 + span("_ty", lo_y) ** 2)}
        )
        upto = Window.partitionBy(target_key).orderBy("_max").rangeBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(target_key)
        nodes = nodes.withColumn("_cum", F.sum("cnt").over(upto)).withColumn(
            "_bound", F.coalesce(F.min(F.when(F.col("_cum") >= k, F.col("_max"))).over(whole), F.lit(limit))
        )
        # a hair of slack keeps nodes whose edge lies exactly on the bound
        keep = F.col("_min") <= F.least(F.col("_bound"), F.lit(limit)) * (1 + 1e-9) + 1e-6
        state = settle(nodes.where(keep).drop("_min", "_max", "_cum", "_bound"), "tree")
        level += 1
    leaves = F.array(*[
        F.struct(F.lit(n).alias("level"), index("_sx", x0, n).alias("ni"), index("_sy", y0, n).alias("nj")) for n in range(level + 1)
    ])
    listed = places.withColumn("_leaf", F.explode(leaves)).select(site_key, "_sx", "_sy", "_leaf.*")
    near = salted_join(state.drop("cnt"), listed, ["level", "ni", "nj"], [target_key]).withColumn("d", distance("_sx", "_sy", "_tx", "_ty"))
    order = Window.partitionBy(target_key).orderBy("d", site_key)
    best = near.where(F.col("d") <= F.lit(limit)).select(target_key, site_key, "d", F.row_number().over(order).alias("rn"))
    return best.where(F.col("rn") <= k)


def within_distance(targets: DataFrame, sites: DataFrame, target_key: str, site_key: str, reach: float) -> DataFrame:
    """``(target, within)``: 1 when the nearest site lies within ``reach``."""
    near = k_nearest(targets, sites, target_key, site_key, 1, max_radius=reach).select(target_key, F.lit(1).alias("within"))
    return targets.select(target_key).join(near, target_key, "left").fillna(0, ["within"])


def line_distance(targets: DataFrame, segments: DataFrame, target_key: str, segment_key: str, reach: float) -> DataFrame:
    """``(target, d)``: distance to the nearest segment, null beyond ``reach``.

    A segment is listed under the bins of its own bounding box; targets look at the 3 x 3 bins
    around them, so bins as wide as ``reach`` are enough.
    """
    spread = segments.select(
        F.col(segment_key),
        "x1", "y1", "x2", "y2",
        F.explode(F.sequence(cell_index(F.least("x1", "x2"), reach), cell_index(F.greatest("x1", "x2"), reach))).alias("bi"),
        F.sequence(cell_index(F.least("y1", "y2"), reach), cell_index(F.greatest("y1", "y2"), reach)).alias("_bj"),
    ).withColumn("bj", F.explode("_bj")).drop("_bj")
    spots = _neighbour_bins(_bins(targets.select(target_key, F.col("x").alias("px"), F.col("y").alias("py")), "px", "py", reach))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    norm = dx * dx + dy * dy
    along = ((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy) / F.when(norm > 0, norm).otherwise(1.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    d = distance("px", "py", F.col("x1") + t * dx, F.col("y1") + t * dy)
    near = (
        salted_join(spread, spots, ["bi", "bj"], [segment_key])
        .withColumn("d", d)
        .where(F.col("d") <= F.lit(float(reach)))
        .groupBy(target_key)
        .agg(F.min("d").alias("d"))
    )
    return targets.select(target_key).join(near, target_key, "left")


def gazetteer_lookup(addresses: DataFrame, levels: Sequence[tuple[str, DataFrame]], identity: Sequence[str]) -> DataFrame:
    """Coordinates from the most precise directory that knows the address.

    ``levels`` lists ``(name, directory)`` from precise to coarse; a directory has one row per
    ``name`` key with ``x`` and ``y``, and ``addresses`` has one key column per level.
    """
    out = addresses
    xs, ys, precision = [], [], None
    for name, book in levels:
        side = book.select(F.col(name), F.col("x").alias(f"_{name}_x"), F.col("y").alias(f"_{name}_y"))
        out = salted_join(out, side, [name], identity, "left")
        hit = F.col(f"_{name}_x").isNotNull()
        precision = F.when(hit, name) if precision is None else precision.when(hit, name)
        xs.append(f"_{name}_x")
        ys.append(f"_{name}_y")
    return out.withColumns(
        {"x": F.coalesce(*xs), "y": F.coalesce(*ys), "precision": precision.otherwise("unknown")}
    ).drop(*xs, *ys)


def first_source(base: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, columns: Sequence[str]) -> DataFrame:
    """Attributes from the first source that has them; ``src`` names the first source that matched.

    Sources have one row per key.
    """
    out = base
    src = None
    for name, frame in sources:
        side = frame.select(F.col(key), F.lit(True).alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in columns])
        out = out.join(side, key, "left")
        hit = F.coalesce(F.col(f"_{name}"), F.lit(False))
        src = F.when(hit, name) if src is None else src.when(hit, name)
    filled = {c: F.coalesce(*[F.col(f"_{n}_{c}") for n, _ in sources]) for c in columns}
    return out.select(*base.columns, *[v.alias(c) for c, v in filled.items()], src.alias("src"))
