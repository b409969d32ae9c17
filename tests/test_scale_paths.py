"""The paths that only large or skewed tables take, forced on small ones and compared with brute force."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.operators import index, interpolate, model, ordering, rain, spatial, terrain, topk, validate
from rillgrid.skew import heavy_keys, salted_join
from rillgrid.staging import settle, shared_dir


def test_salted_join_equals_plain_join(spark):
    many = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k")
    )
    few = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert [r["k"] for r in heavy_keys(many, ["k"], 0.1, 10).collect()] == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = many.join(few, "k", how).collect()
        salted = salted_join(many, few, ["k"], ["id"], how, salts=8, share=0.1, least=10).collect()
        assert sorted(map(str, plain)) == sorted(map(str, salted))


@pytest.mark.parametrize("least", [10, 10_000])
def test_large_salted_join_broadcasts_heavy_keys_only(spark, least):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    few = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        joined = salted_join(many, few, ["k"], ["id"], how, salts=8, share=0.1, least=least, large=True)
        broadcast = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert len(broadcast) == (2 if least == 10 else 0) and all("LeftOuter" in line for line in broadcast)
        assert sorted(map(str, joined.collect())) == sorted(map(str, many.join(few, "k", how).collect()))


@pytest.mark.parametrize("descending", [False, True])
def test_cumulate_in_ranges_equals_one_scan(spark, descending):
    df = spark.range(5000).select(
        (F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.round(F.rand(3) * 1000, 1)).alias("v"), (F.col("id") % 7).alias("w")
    ).cache()
    a = ordering.cumulate(df, "v", {"w": F.col("w")}, by=["g"], descending=descending, small=0)
    b = ordering.cumulate(df, "v", {"w": F.col("w")}, by=["g"], descending=descending)
    assert sorted(a.select(b.columns).collect()) == sorted(b.collect())


def test_quantiles_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL", 0)
    values = [random.Random(5).gauss(0, 1) for _ in range(2000)]
    df = spark.createDataFrame([(v, float(k % 10)) for k, v in enumerate(values)], "a double, b double")
    got = {(r["var"], r["p"]): r["q"] for r in ordering.quantiles(df, ["a", "b"], [0.01, 0.37, 0.99]).collect()}
    for p in (0.01, 0.37, 0.99):
        assert got[("a", p)] == pytest.approx(np.quantile(values, p))
        assert got[("b", p)] == pytest.approx(np.quantile(np.arange(2000) % 10, p))


@pytest.mark.parametrize("k,reach,pairs", [(1, None, 256), (5, None, 0), (6, 700.0, 0), (6, 700.0, 256)])
def test_k_nearest_with_crowded_sites(spark, k, reach, pairs):
    rng = np.random.default_rng(1)
    sites = np.concatenate([rng.uniform(0, 4000, (400, 2)), rng.normal(1000, 0.5, (300, 2)), np.repeat([[2000.0, 2000.0]], 200, 0)])
    targets = np.concatenate([rng.uniform(-300, 4300, (60, 2)), rng.normal(1000, 2, (40, 2))])
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "sid int, x double, y double")
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(targets)], "tid int, x double, y double")
    want = set()
    for n, (x, y) in enumerate(targets):
        d = np.hypot(sites[:, 0] - x, sites[:, 1] - y)
        want |= {(n, int(j)) for j in np.lexsort((np.arange(len(sites)), d))[:k] if d[j] <= (reach or np.inf)}
    got = spatial.k_nearest(t, s, "tid", "sid", k, reach, pairs_per_row=pairs)
    assert {(r["tid"], r["sid"]) for r in got.collect()} == want


def test_k_nearest_without_sites(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0)], "tid int, x double, y double")
    assert spatial.k_nearest(t, t.limit(0).withColumnRenamed("tid", "sid"), "tid", "sid").count() == 0


def test_polygon_with_hole_and_concave_ring(spark):
    P = lambda *pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    rings = spark.createDataFrame(
        [(1, P((0, 0), (400, 0), (400, 400), (0, 400))), (1, P((100, 100), (100, 300), (300, 300), (300, 100))),
         (2, P((0, 0), (400, 0), (400, 400), (200, 100), (0, 400)))],
        "pid int, ring array<struct<x: double, y: double>>",
    )
    pts = spark.createDataFrame([(0, 50.0, 50.0), (1, 200.0, 200.0), (2, 200.0, 50.0), (3, 350.0, 250.5), (4, 500.0, 200.0)], "id int, x double, y double")
    got = spatial.point_in_polygon(pts, spatial.ring_edges(rings, "pid"), "pid", ["id"])
    assert {(r["pid"], r["id"]) for r in got.collect()} == {(1, 0), (1, 2), (1, 3), (2, 0), (2, 2), (2, 3)}
    area = spatial.cell_polygon_overlap(rings.where("pid = 2"), "pid").agg(F.sum("area"), F.max("area")).first()
    assert area[0] == pytest.approx(400 * 400 - 0.5 * 400 * 300) and area[1] <= 10_000 + 1e-6


def inside(x, y, rings):
    """Whether a ray to the right passes an odd number of edges of the rings."""
    odd = False
    for ring in rings:
        for k, (x2, y2) in enumerate(ring):
            x1, y1 = ring[k - 1]
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def contained(spark, shapes, points):
    """Pairs (polygon, point) by the operator."""
    rows = [(p, [{"x": float(x), "y": float(y)} for x, y in ring]) for p, rings in shapes.items() for ring in rings]
    rings = spark.createDataFrame(rows, "pid int, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id int, x double, y double")
    return sorted((r["pid"], r["id"]) for r in spatial.point_in_polygon(pts, spatial.ring_edges(rings, "pid"), "pid", ["id"]).collect())


def test_polygons_with_corners_on_cell_borders(spark):
    rng = random.Random(11)
    step = lambda n: (rng.randrange(-n, n) * 50, rng.randrange(-n, n) * 50)
    # rings that cross themselves, run along borders of cells and repeat corners; the rule of odd counts holds for them too
    shapes = {p: [[step(4 + p % 9) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 4))] for p in range(60)}
    shapes[60] = [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)], [(300, 300), (700, 300), (700, 700), (300, 700)]]
    points = [(rng.randrange(-700, 700) + 0.37, rng.randrange(-700, 700) + 0.11) for _ in range(500)]
    want = sorted((p, k) for p, rings in shapes.items() for k, (x, y) in enumerate(points) if inside(x, y, rings))
    assert contained(spark, shapes, points) == want


def test_many_edges_of_one_polygon_in_one_cell(spark):
    comb = [(10 + 0.02 * k, 20 if k % 2 else 80) for k in range(4000)] + [(90, 5), (10, 5)]
    points = [(11.013 + k * 0.731, 7.0 + k * 0.83) for k in range(100)] + [(50.003, 50.0)] * 3
    want = sorted((1, k) for k, (x, y) in enumerate(points) if inside(x, y, [comb]))
    assert contained(spark, {1: [comb]}, points) == want and 20 < len(want) < 103
    rings = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in comb])], "pid int, ring array<struct<x: double, y: double>>")
    _, border = spatial.polygon_cover(spatial.ring_edges(rings, "pid"), "pid")
    assert border.agg(F.max(F.size("edges"))).first()[0] <= 2 * spatial.EDGES
    alike = spark.createDataFrame([(7, 50.003, 15.0)] * 3, "id int, x double, y double")
    assert spatial.point_in_polygon(alike, spatial.ring_edges(rings, "pid"), "pid", ["id"]).count() == 3


def test_many_layers_over_one_cell(spark):
    n = 5000
    shapes = {p: [[(50 - p % 60 - 1, 10), (160 + p % 7, 10), (160, 190), (20, 95 + p % 3)]] for p in range(n)}
    points = [(55.5, 50.25), (5.5, 50.25), (250.0, 50.0)]
    want = sorted((p, k) for p, rings in shapes.items() for k, (x, y) in enumerate(points) if inside(x, y, rings))
    assert contained(spark, shapes, points) == want


def test_cells_wholly_inside_carry_no_edges(spark):
    square = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ((50.0, 50.0), (5050.0, 50.0), (5050.0, 5050.0), (50.0, 5050.0))])], "pid int, ring array<struct<x: double, y: double>>")
    inner, border = spatial.polygon_cover(spatial.ring_edges(square, "pid"), "pid")
    assert inner.count() == inner.distinct().count() == 49 * 49 and border.count() == 4 * 50


def clipped_area(ring, x0, y0, size):
    """Clip a ring by the four sides of a square, then the shoelace sum."""
    pts = ring
    for axis, limit, sign in ((0, x0, 1), (0, x0 + size, -1), (1, y0, 1), (1, y0 + size, -1)):
        out = []
        for k, b in enumerate(pts):
            a = pts[k - 1]
            in_a, in_b = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if in_a != in_b:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if in_b:
                out.append(b)
        pts = out
    return abs(sum(pts[k - 1][0] * p[1] - p[0] * pts[k - 1][1] for k, p in enumerate(pts))) / 2


def test_overlap_of_parts_and_holes_equals_clipping(spark):
    rng = random.Random(4)

    def star(cx, cy, r, n):
        far = [r * rng.uniform(0.3, 1) for _ in range(n)]
        return [(cx + d * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)) for k, d in enumerate(far)]

    polygons = {p: [(star(rng.uniform(-500, 500), rng.uniform(-500, 500), 700, 40), False)] for p in range(6)}
    polygons[6] = [([(0.0, 0.0), (1000.0, 0.0), (1000.0, 800.0), (0.0, 800.0)], False), (star(500, 400, 250, 9), True), (star(3000, 100, 300, 12), False)]
    polygons[7] = [([(-300.0, -300.0), (-300.0, 300.0), (300.0, 300.0), (300.0, -300.0)], False), ([(-100.0, -100.0), (100.0, -100.0), (100.0, 100.0), (-100.0, 100.0)], True)]
    polygons[8] = [([(0.0, 0.0), (1.0, 1.0)], False), ([(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)], False), ([(50.0, 50.0), (60.0, 50.0), (55.0, 1e5)], False)]
    rows = [(p, [{"x": x, "y": y} for x, y in (ring[::-1] if k % 2 else ring)], hole) for p, rings in polygons.items() for k, (ring, hole) in enumerate(rings)]
    df = spark.createDataFrame(rows, "pid int, ring array<struct<x: double, y: double>>, hole boolean").repartition(5)
    got = {(r["pid"], r["i"], r["j"]): r["area"] for r in spatial.cell_polygon_overlap(df, "pid", 100, "hole").collect()}
    want = {}
    for p, rings in polygons.items():
        for ring, hole in rings:
            if len(ring) < 3:
                continue
            for i in range(math.floor(min(x for x, _ in ring) / 100), math.floor(max(x for x, _ in ring) / 100) + 1):
                for j in range(math.floor(min(y for _, y in ring) / 100), math.floor(max(y for _, y in ring) / 100) + 1):
                    want[p, i, j] = want.get((p, i, j), 0.0) + (-1 if hole else 1) * clipped_area(ring, i * 100.0, j * 100.0, 100.0)
    want = {k: v for k, v in want.items() if v > 1e-4}
    assert {k for k, v in got.items() if v > 1e-4} == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())


def test_overlap_of_a_long_outline(spark):
    """A ring of 40,000 corners: its cells and its area."""
    n = 20_000
    lower = [(k / 100.0, (k % 2) * 10.0) for k in range(n)]
    ring = lower + [(x, y + 100.0) for x, y in reversed(lower)]
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "pid int, ring array<struct<x: double, y: double>>")
    cells = spatial.cell_polygon_overlap(df, "pid").agg(F.count("area"), F.sum("area"), F.max("area")).first()
    assert cells[0] == 4 and cells[1] == pytest.approx((n - 1) / 100.0 * 100.0) and cells[2] <= 10_000


def test_idw_exact_at_a_station_and_flag_far_cells(spark):
    st = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 100.0, 0.0, 9.0)], "sid int, x double, y double, v double")
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 0.0), ("c", 5000.0, 0.0)], "gid string, x double, y double")
    out = {r["gid"]: (r["value"], r["extrapolated"]) for r in interpolate.idw(st, cells, "sid", "gid", "v", radius=1000.0).collect()}
    assert out["a"][0] == pytest.approx(5.0, abs=1e-6) and out["b"] == (pytest.approx(7.0), False) and out["c"] == (9.0, True)


def test_suppression_is_greedy_separated_and_maximal(spark):
    rng = random.Random(3)
    cells = [(f"c{i:03d}", float(rng.randrange(15) * 100), float(rng.randrange(15) * 100), float(rng.randrange(20))) for i in range(150)]
    df = spark.createDataFrame(cells, "k string, x double, y double, s double")
    greedy = []
    for c in sorted(cells, key=lambda c: (-c[3], c[0])):
        if all((c[1] - g[1]) ** 2 + (c[2] - g[2]) ** 2 > 300**2 for g in greedy):
            greedy.append(c)
    assert {r["k"] for r in topk.suppress_neighbours(df, "s", "k").collect()} == {g[0] for g in greedy}
    first = topk.top_n_spaced(df, "s", "k", 5)
    assert {r["k"] for r in first.collect()} == {g[0] for g in greedy[:5]}


def test_suppression_follows_a_long_ramp_in_few_rounds(spark, monkeypatch):
    """A falling line of 3,000 cells is one chain of decisions; tiles walk it in long steps."""
    rounds = []
    real = topk.settle
    monkeypatch.setattr(topk, "settle", lambda df, name: (rounds.append(name), real(df, name))[1])
    cells = spark.range(3000).select(F.format_string("%05d", "id").alias("k"), (F.col("id") * 100.0).alias("x"), F.lit(50.0).alias("y"), (-F.col("id")).cast("double").alias("s"))
    kept = sorted(int(r["k"]) for r in topk.suppress_neighbours(cells, "s", "k").collect())
    assert kept == list(range(0, 3000, 4)) and len(rounds) <= 41
    rounds.clear()
    assert [int(r["k"]) for r in topk.top_n_spaced(cells, "s", "k", 5).collect()] == [0, 4, 8, 12, 16]
    assert len(rounds) == 2


def test_suppression_at_exactly_the_reach(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 2.0), ("b", 300.0, 0.0, 1.0), ("c", 600.1, 0.0, 1.0)], "k string, x double, y double, s double")
    assert {r["k"] for r in topk.suppress_neighbours(df, "s", "k").collect()} == {"a", "c"}


def _flood(z):
    """Reference answer for pit filling: the lowest way out, cell by cell."""
    rows, cols = z.shape
    level = np.full(z.shape, np.inf)
    heap = []
    for r in range(rows):
        for c in range(cols):
            if r in (0, rows - 1) or c in (0, cols - 1):
                level[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        h, r, c = heapq.heappop(heap)
        if h > level[r, c]:
            continue
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                a, b = r + dr, c + dc
                if 0 <= a < rows and 0 <= b < cols and max(h, z[a, b]) < level[a, b]:
                    level[a, b] = max(h, z[a, b])
                    heapq.heappush(heap, (level[a, b], a, b))
    return level


def test_filled_sinks_equal_the_lowest_way_out(spark):
    z = np.random.default_rng(4).integers(0, 12, (14, 17)).astype(float)
    px = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(14) for c in range(17)], "row int, col int, z double")
    got = np.zeros(z.shape)
    for r in terrain.fill_sinks(px, tile=5).collect():
        got[r["row"], r["col"]] = r["filled"]
    assert (got == _flood(z)).all()


def test_tiles_do_not_change_neighbours_or_focal_means(spark):
    z = np.random.default_rng(6).integers(0, 50, (23, 19)).astype(float)
    px = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(23) for c in range(19) if (r, c) != (7, 7)], "row int, col int, z double")
    small = terrain.neighbourhood(px, tile=4).orderBy("row", "col").collect()
    large = terrain.neighbourhood(px, tile=64).orderBy("row", "col").collect()
    assert small == large
    hole = np.where(np.arange(23)[:, None] * 19 + np.arange(19) == 7 * 19 + 7, np.nan, z)
    for r in terrain.focal_mean(px, 2, tile=5).collect():
        box = hole[max(0, r["row"] - 2): r["row"] + 3, max(0, r["col"] - 2): r["col"] + 3]
        assert r["focal"] == pytest.approx(np.nanmean(box))


def test_flat_ground_has_no_direction(spark):
    px = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5)], "row int, col int, z double")
    flow = terrain.flow_direction(px)
    assert flow.where("ptr is not null").count() == 0
    assert {r["upstream"] for r in terrain.flow_accumulation(flow).collect()} == {1}


def test_rolling_sums_and_events_across_bucket_borders(spark):
    rng = random.Random(9)
    hours = sorted(rng.sample(range(0, 2400), 700))
    base = 1_704_067_200
    df = spark.createDataFrame([(1, base + h * 3600, float(rng.randrange(0, 5))) for h in hours], "station int, t long, mm double")
    hourly = df.select("station", F.timestamp_seconds("t").cast("timestamp_ntz").alias("hour"), "mm")
    rows = {r["hour"]: r for r in rain.rolling_sums(hourly, (3, 24)).collect()}
    source = {r["hour"]: r["mm"] for r in hourly.collect()}
    for h, r in rows.items():
        for n in (3, 24):
            assert r[f"mm_{n}h"] == sum(v for k, v in source.items() if 0 <= (h - k).total_seconds() < n * 3600)
    wet = sorted(k for k, v in source.items() if v > 0)
    starts = [w for k, w in enumerate(wet) if k == 0 or (w - wet[k - 1]).total_seconds() > 6 * 3600]
    assert sorted(r["event_start"] for r in rain.rain_events(hourly, 6).collect()) == starts


def test_group_folds_are_disjoint_and_level(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"))
    folds = model.group_folds(df, "g", 5).collect()
    assert len(folds) == 37 and {r["fold"] for r in folds} == set(range(5))
    sizes = [sum(r["size"] for r in folds if r["fold"] == f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 40


def test_contribution_adds_up(spark):
    df = spark.createDataFrame([("a", 0.2, 0.3, 0.5), ("b", 0.9, 0.1, 0.1)], "k string, h double, e double, v double")
    out = {r["k"]: r for r in index.contribution(df, {"h": 1 / 3, "e": 1 / 3, "v": 1 / 3}, "k").collect()}
    assert sum(out["a"][f"pct_{p}"] for p in "hev") == pytest.approx(100) and out["b"]["main_cause"] == "h"


def test_settled_tables_live_in_the_shared_folder(spark):
    path = settle(spark.range(3), "probe").inputFiles()[0]
    assert shared_dir(spark).split(":")[-1].lstrip("/") in path


def test_boosted_trees_with_a_separate_validation_part(spark):
    df = spark.range(400).select(
        F.col("id"), (F.col("id") % 20).cast("double").alias("a"), F.rand(2).alias("b"), (F.col("id") % 8).alias("g")
    ).withColumn("label", (F.col("a") > 12).cast("int"))
    df = model.holdout_split(df, "id", 0.25).withColumnRenamed("is_test", "hold")
    fitted = model.fit_weighted(model.boosted_trees(["a", "b"], trees=8, depth=3, validation="hold"), df)
    assert fitted.stages[-1].getNumTrees <= 8
    importance = {r["feature"]: r["importance"] for r in model.feature_importance(fitted, ["a", "b"], spark).collect()}
    assert importance["a"] > 0.9
    drop = {r["feature"]: r["auc_drop"] for r in model.permutation_importance(fitted, df, ["a", "b"], "id").collect()}
    assert drop["a"] > 0.2 > abs(drop["b"])
    again = model.permutation_importance(fitted, df.repartition(5), ["b", "a"], "id").collect()
    assert [r["feature"] for r in again] == ["a", "b"] and {r["feature"]: r["auc_drop"] for r in again} == pytest.approx(drop)
    parts = df.select("label", "b", (F.col("id") % 3).cast("int").alias("part"))
    each = {r["part"]: r["auc"] for r in validate.roc_auc_of(parts, "label", "b", "part", range(3)).collect()}
    assert each == pytest.approx({k: validate.roc_auc(parts.where(F.col("part") == k), "label", "b").first()["auc"] for k in range(3)})


def test_out_of_fold_covers_every_row_once(spark):
    df = spark.range(300).select("id", (F.col("id") % 11).alias("g"), F.rand(5).alias("a")).withColumn("label", (F.col("a") + F.rand(6) * 0.3 > 0.6).cast("int")).cache()
    oof = model.out_of_fold(df, model.group_folds(df, "g", 3), "g", "id", model.baseline_logistic(["a"]), 3)
    assert oof.count() == 300 and oof.select("id").distinct().count() == 300
    assert oof.join(df, "id").groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert model.scores_of(settle(oof, "oof")).first()["auc"] > 0.8


def test_a_missing_pixel_hides_only_itself(spark):
    px = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (0, 1)], "row int, col int, z double")
    flow = {(r["row"], r["col"]): (r["down_row"], r["down_col"]) for r in terrain.flow_direction(px).collect()}
    assert flow[1, 1] == (0, 0)  # the corner, although the pixel above is missing
    want = np.mean([z for r in range(3) for c in range(3) if (r, c) != (0, 1) for z in [10.0 * r + c]])
    focal = {(r["row"], r["col"]): r["focal"] for r in terrain.focal_mean(px, 1).collect()}
    assert abs(focal[1, 1] - want) < 1e-9 and (0, 1) not in focal
