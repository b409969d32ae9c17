"""Flow over flats against breadth-first search on whole grids."""

import heapq
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.operators import terrain
from rillgrid.plans import load_all, terrain_queries
from rillgrid.plans.registry import QUERIES
from rillgrid.staging import settle

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def brute_ways(z):
    """Steps of each pixel to one that drains, and the next pixel of flat ones."""
    near = {p: [(p[0] + a, p[1] + b) for a, b in AROUND if (p[0] + a, p[1] + b) in z] for p in z}
    drains = {p for p in z if len(near[p]) < 8 or any(z[q] < z[p] for q in near[p])}
    steps, queue = dict.fromkeys(drains, 0), deque(drains)
    while queue:
        p = queue.popleft()
        for q in near[p]:
            if q not in steps and z[q] == z[p]:
                steps[q] = steps[p] + 1
                queue.append(q)
    return steps, {p: min(q for q in near[p] if z[q] == z[p] and steps.get(q) == steps[p] - 1) for p in steps if steps[p]}


def surfaces():
    rng = random.Random(1)
    walls = {(r, c) for r in range(2, 38) for c in range(2, 58) if c % 4 == 0 and r != (3 if c % 8 else 36)}
    maze = {(r, c): 9.0 if (r, c) in walls else 1.0 for r in range(40) for c in range(60)}
    for r in range(40):
        for c in range(60):
            if r in (0, 1, 38, 39) or c in (0, 1, 58, 59):
                maze[r, c] = 9.0
    maze[2, 1], maze[2, 0] = 1.0, 0.0  # one way out of a winding lake
    lakes = {(r, c): float(rng.choice([1, 1, 1, 2])) for r in range(37) for c in range(45)}
    holes = {p: v for p, v in lakes.items() if rng.random() > 0.03}
    return {"maze": maze, "lakes": lakes, "holes": holes, "plane": dict.fromkeys([(r, c) for r in range(20) for c in range(20)], 5.0)}


@pytest.mark.parametrize(("name", "tile"), [("maze", 16), ("lakes", 8), ("holes", 8), ("plane", 64)])
def test_flats_drain_by_the_nearest_outlet(spark, name, tile):
    z = surfaces()[name]
    px = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double").repartition(4)
    found = terrain.flow_over_flats(px, tile=tile).collect()
    steps, ways = brute_ways(z)
    assert len(found) == len(z)
    for r in found:
        p = (r["row"], r["col"])
        assert r["steps"] == steps.get(p), p
        if p in ways:
            assert (r["down_row"], r["down_col"]) == ways[p], p


def test_everything_leaves_a_filled_surface(spark):
    rng = random.Random(2)
    px = spark.createDataFrame([(r, c, float(rng.randint(0, 6))) for r in range(50) for c in range(50)], "row int, col int, z double")
    flow = terrain.flow_over_flats(terrain.fill_sinks(px, 16).select("row", "col", F.col("filled").alias("z")), tile=16)
    ends = flow.join(terrain.flow_accumulation(flow), "id").where("ptr IS NULL")
    assert ends.where("NOT border").count() == 0 and ends.agg(F.sum("upstream")).first()[0] == 2500


def test_no_pixels(spark):
    assert terrain.flow_over_flats(spark.createDataFrame([], "row int, col int, z double"), tile=8).count() == 0


def test_a_tile_hands_on_a_spanning_tree_only(spark):
    rng = np.random.default_rng(5)
    size, n = 16, 20
    row, col = (x.ravel() for x in np.mgrid[-2 : n - 2, -2 : n - 2])
    owned, level, basin, passes = terrain.basins_of_tile(row, col, rng.integers(0, 9, n * n).astype(float), 0, 0, size)
    rim = 4 * size - 4
    assert owned.sum() == size * size and len(set(basin.tolist())) == rim and (level >= 0).all()
    inside = {(r << 32) + c for r in range(size) for c in range(size)}
    # both ways through the tree, and three ways out of each side pixel
    assert sum(b in inside for _, b, _ in passes) == 2 * (rim - 1) and len(passes) == 2 * (rim - 1) + 12 * size - 4


def test_filling_over_tiles_and_missing_heights(spark):
    rng = random.Random(7)
    z = {(r, c): None if rng.random() < 0.02 else float(rng.randint(0, 30)) for r in range(-5, 40) for c in range(3, 45)}
    px = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double").repartition(5)
    known = {p: v for p, v in z.items() if v is not None}
    want, heap = {}, [(v, p) for p, v in known.items() if any((p[0] + a, p[1] + b) not in known for a, b in AROUND)]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if p not in want:
            want[p] = v
            for a, b in AROUND:
                q = (p[0] + a, p[1] + b)
                if q in known and q not in want:
                    heapq.heappush(heap, (max(v, known[q]), q))
    for tile in (8, 64):
        found = terrain.fill_sinks(px, tile)
        assert [t for _, t in found.dtypes] == ["int", "int", "double", "double"]
        assert {(r["row"], r["col"]): r["filled"] for r in found.collect()} == {p: want.get(p) for p in z}


@pytest.mark.parametrize("tile", [4, 16])
def test_accumulation_over_tiles(spark, tile, monkeypatch):
    rng = random.Random(3)
    z = {(r, c): 3.0 * r + 2.0 * c + rng.randint(0, 4) for r in range(-6, 30) for c in range(2, 40)}
    # a way that winds through many tiles and comes back to some
    z |= {(100 + r, c): 1000.0 for r in range(30) for c in range(30)}
    snake = [(100 + r, c if r % 4 == 0 else 29 - c) for r in range(0, 30, 2) for c in range(30)]
    z |= {p: 900.0 - i for i, p in enumerate(snake)}
    flow = terrain.flow_direction(spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double"), tile=8).cache()
    down = {r["id"]: r["ptr"] for r in flow.collect()}
    want = dict.fromkeys(down, 0)
    for p in down:
        while p is not None:
            want[p] += 1
            p = down[p]
    asked = []
    inner = terrain._accumulated
    monkeypatch.setattr(terrain, "_accumulated", lambda nodes, *a: asked.append(nodes.count()) or inner(nodes, *a))
    got = {r["id"]: r["upstream"] for r in terrain.flow_accumulation(flow, tile=tile).collect()}
    assert got == want and asked[0] < len(want) * (0.9 if tile == 4 else 0.4)


def test_a_loop_is_an_error(spark):
    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, ptr long")
    with pytest.raises(Exception, match="loop"):
        terrain.flow_accumulation(flow).collect()


@pytest.mark.parametrize("tile", [4, 16])
def test_roots_over_tiles(spark, tile):
    rng = random.Random(4)
    z = {(r, c): float(rng.randint(0, 50)) + r + c for r in range(-6, 40) for c in range(2, 40)}
    flow = terrain.flow_direction(spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row int, col int, z double"), tile=8)
    flow = flow.union(spark.createDataFrame([(3_000_000 * 2**32 + i, 0, 0, 0.0, 0, 0, 3_000_000 * 2**32 + i + 1 if i < 300 else None, False) for i in range(301)], flow.schema)).cache()
    want = {r["id"]: r["root"] for r in terrain.follow_to_root(flow.select("id", "ptr")).collect()}
    assert {r["id"]: r["root"] for r in terrain.pixel_roots(flow.select("id", "ptr"), tile=tile).collect()} == want


def test_rounds_bring_back_the_edges_of_tiles_only(spark):
    """A flat tile of 8 x 8 with one way out: a round returns 28 of its 64 pixels, with the steps of the whole answer."""
    cell = "array<struct<row:long,col:long,z:double,out_row:long,out_col:long>>"
    rows = [(r, c, 1.0, -1, -1) for r in range(8) for c in range(8, 16)]
    rows[0] = (0, 8, 1.0, 0, 7)
    tiles = spark.createDataFrame([(0, 1, rows)], f"tr long, tc long, cells {cell}")
    whole = {(r["row"], r["col"]): r["steps"] for r in terrain._solved(tiles, None, 8).collect()}
    edges = {(r["row"], r["col"]): r["steps"] for r in terrain._solved(tiles, None, 8, edges=True).collect()}
    assert whole == {(r, c): max(r, c - 8) + 1 for r in range(8) for c in range(8, 16)}
    assert edges == {p: s for p, s in whole.items() if p[0] in (0, 7) or p[1] in (8, 15)} and len(edges) == 28


@pytest.mark.parametrize("name", ["tr6_wetness_filled", "tr7_height_above_channel_filled"])
def test_no_pixels_or_tile_edges_are_broadcast(spark, monkeypatch, name):
    """Written pixels compress so well that the size of their files lets the optimizer broadcast millions of them."""
    load_all()
    plans = []

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, *rest)

    monkeypatch.setattr(terrain, "settle", noted)
    monkeypatch.setattr(terrain_queries, "settle", noted)
    monkeypatch.setattr(terrain, "HEAVY_ROWS", 0, raising=False)
    noted(QUERIES[name](spark, "/root/testdata/sf0.001"))
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in j for j in joins) > 10
    assert not [j for j in joins if "Broadcast" in j and "LeftSemi" not in j]  # the numbers of tiles are few
