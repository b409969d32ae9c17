"""Nearest neighbours by learned partitions.

A bounded sample of distinct vectors gets a neighbour graph, the graph is cut into equal parts that
separate few neighbours (halved again and again along its second eigenvector, then improved by
swaps), and a small network learns which parts the neighbours of a vector lie in.  Every row is then
indexed under its most probable part; a query goes to its most probable parts and is ranked there by
exact distances in double precision.  How many parts a query visits is settled on the sample: as few
as reach ``goal`` of the true neighbours there.

Parts are searched in blocks: a part with many vectors has many blocks, and the queries of a part are
dealt to blocks too, so a vector that holds a third of the rows fills blocks, not one task.

A sample of ``FIT_ROWS`` carries ``FIT_ROWS`` / 32 parts at most; the number of parts grows with the rows up to there.  A query whose parts hold
fewer than ``k`` rows goes on to its next ones.

Edge cases: a row without an id takes no part, neither do vectors that are null, empty or zero, that hold null or non-finite components, or that have
another length than most.  Rows with the query's id are its own and never its neighbours.
Rows that share id and vector ask once.  Equal distances are ordered by id.  Fewer candidates than
``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.session import ship
from rillgrid.staging import settle

FIT_ROWS = 6_000  # distinct vectors of the sample; bounds what the driver holds and does
PARTS, PART_ROWS = 32, 4_000  # parts of a small table; rows of a part beyond which there are more of them
GRAPH = 12  # neighbours of a vector in the graph
GOAL = 0.97
BLOCK = 8_192  # vectors, or queries, that meet in one task


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of each row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    norms = (x * x).sum(axis=1)
    for at in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split nodes ``own`` into equal halves along the second eigenvector of the graph between them."""
    place = np.full(int(own.max()) + 1 if len(own) else 0, -1)
    place[own] = np.arange(len(own))
    inside = edges[(edges < len(place)).all(axis=1)]
    a, b = place[inside[:, 0]], place[inside[:, 1]]
    met = (a >= 0) & (b >= 0)
    a, b = np.concatenate((a[met], b[met])), np.concatenate((b[met], a[met]))
    degree = np.bincount(a, minlength=len(own)) + 1.0
    v = np.cos(np.arange(len(own)) * 2.399963)  # a fixed start without structure
    for _ in range(80):  # the walk that stays with one half settles on the second eigenvector
        v = 0.5 * v + 0.5 * (np.bincount(a, weights=v[b], minlength=len(own)) + v) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.abs(v).max() or 1.0
    order = np.argsort(v, kind="stable")
    half = len(own) // 2
    side = np.zeros(len(own), dtype=bool)
    side[order[half:]] = True
    for _ in range(5):  # swap equally many nodes whose neighbours are mostly on the other side
        gain = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=len(own))
        left, right = np.flatnonzero((gain > 0) & ~side), np.flatnonzero((gain > 0) & side)
        n = min(len(left), len(right)) // 2
        if not n:
            break
        side[left[np.argsort(-gain[left], kind="stable")[:n]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:n]]] = False
    return own[~side], own[side]


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part number for each node; parts differ by at most a few nodes in size. ``parts`` is a power of two."""
    edges = np.stack((np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()), axis=1)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [h for g in groups for h in _halves(g, edges)]
    label = np.zeros(len(graph), dtype=np.int64)
    for i, g in enumerate(groups):
        label[g] = i
    return label


@dataclass
class Router:
    """A network with one hidden layer from a vector to probabilities of the parts."""

    mean: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int = 1

    @property
    def parts(self) -> int:
        return self.layers[-1].shape[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(((x - self.mean) / self.scale) @ w1 + b1, 0) @ w2 + b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def train_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, rounds: int = 40, seed: int = 7) -> Router:
    """Learn the shares of the parts among each vector's neighbours and itself."""
    rng = np.random.default_rng(seed)
    want = np.full((len(x), parts), 0.0)
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    want[np.arange(len(x)), label] += 1.0
    want /= want.sum(axis=1, keepdims=True)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    router = Router(mean, scale, [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in router.layers]
    t = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            w1, b1, w2, b2 = router.layers
            z = (x[i] - mean) / scale
            h = np.maximum(z @ w1 + b1, 0)
            p = h @ w2 + b2
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - want[i]) / len(i)
            gh = (g @ w2.T) * (h > 0)
            t += 1
            for j, d in enumerate((z.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m, v = moments[j]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                router.layers[j] = router.layers[j] - 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return router


def fit_sample(x: np.ndarray, parts: int = PARTS, k: int = 10, goal: float = GOAL) -> Router:
    """A router for the sample ``x`` and the number of parts that a query has to visit."""
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    if parts == 1 or len(x) < 2:
        d = x.shape[1]
        return Router(np.zeros(d), 1.0, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = neighbour_graph(x, GRAPH)
    router = train_router(x, graph, balanced_parts(graph, parts), parts)
    ranked = router.ranked(x, parts)
    near = neighbour_graph(x, k)
    step = np.argsort(ranked, axis=1)  # at which probe a part is visited
    visited = np.sort(np.take_along_axis(step, ranked[:, 0][near], axis=1).ravel())
    router.probes = min(parts, int(visited[int(np.ceil(goal * len(visited))) - 1]) + 1)
    return router


def valid(vector: Column, size: int) -> Column:
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda v: F.coalesce(odd(v), F.lit(True))) & F.exists(vector, lambda v: v != 0)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, written once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    named = rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL")
    common = named.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return settle(named.where(valid(F.col("v"), common["n"] if common else 0)), "vectors")


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, parts: int = PARTS, goal: float = GOAL) -> Router | None:
    """Fit a router on about ``fit_rows`` distinct vectors of ``rows`` (id, v), chosen by a hash."""
    distinct = rows.select(F.xxhash64("v").alias("h"), "v").groupBy("h").agg(F.first("v").alias("v"))
    n = rows.agg(F.approx_count_distinct(F.xxhash64("v"))).first()[0]
    if not n:
        return None
    chosen = distinct.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, fit_rows / n)) + 1)).orderBy("h").select("v").toPandas()
    while parts * PART_ROWS < n:
        parts *= 2
    return fit_sample(_vectors(chosen["v"]), parts=parts, goal=goal) if len(chosen) else None


def _routed(router: Router, rows: DataFrame, n: int) -> Column:
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(router)

    @F.pandas_udf("array<int>")
    def route(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            yield pd.Series(list(shared.value.ranked(_vectors(batch), n).astype(np.int32)) if len(batch) else [], dtype="object")

    return route(F.col("v"))


def _visited(router: Router, counts: dict[int, int], k: int) -> Column:
    """The first parts of ``ranked``: as many as the router asks for, and on until they hold ``k`` rows besides the query's ``own``."""
    held = F.create_map(*[x for p in range(router.parts) for x in (F.lit(p), F.lit(counts.get(p, 0)))])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("parts"))

    def step(s: Column, p: Column) -> Column:
        more = (F.size(s["parts"]) < router.probes) | (s["n"] < k + F.coalesce("own", F.lit(0)))
        return F.when(more, F.struct((s["n"] + F.element_at(held, p)).alias("n"), F.concat(s["parts"], F.array(p)).alias("parts"))).otherwise(s)

    return F.aggregate("ranked", start, step, lambda s: s["parts"])


def search(rows: DataFrame, router: Router, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (id, v) among ``rows`` (id, v)."""
    indexed = settle(rows.select("id", "v", F.get(_routed(router, rows, 1), F.lit(0)).alias("part")), "indexed")
    asked = queries.groupBy("id", F.xxhash64("v").alias("h")).agg(F.first("v").alias("v"))
    # one row per part, of which there are router.parts
    counts = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    asked = settle(asked.select("id", "h", "v", _routed(router, rows, router.parts).alias("ranked")), "ranked")
    own = rows.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = settle(asked.join(own, "id", "left").select("id", "h", "v", F.explode(_visited(router, counts, k)).alias("part")), "asked")
    wanted = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    cut = lambda c: F.coalesce(F.element_at(F.create_map(*[x for p in range(router.parts) for x in (F.lit(p), F.lit(-(-c.get(p, 0) // block)))]), F.col("part")), F.lit(0))
    of_all = lambda c: F.explode(F.when(cut(c) > 0, F.sequence(F.lit(0), cut(c) - 1)).otherwise(F.array().cast("array<int>")))
    left = indexed.withColumn("b", F.pmod(F.xxhash64("id", "v"), cut(counts)).cast("int")).withColumn("q", of_all(wanted))
    right = asked.withColumn("q", F.pmod(F.xxhash64("id", "h"), cut(wanted)).cast("int")).withColumn("b", of_all(counts))

    def meet(key, found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asking):
            x, ids = _vectors(found["v"]), found["id"].to_numpy(dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for i, h, v in zip(asking["id"].tolist(), asking["h"].tolist(), asking["v"], strict=True):
                d = x - np.asarray(v, dtype=np.float64)
                d = (d * d).sum(axis=1)
                d[ids == i] = np.inf
                own = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                best = own[np.argsort(d[own], kind="stable")[:k]]  # equal distances stay in the order of the ids
                out += [(i, h, int(ids[j]), float(d[j])) for j in best if np.isfinite(d[j])]
        return pd.DataFrame(out, columns=["query_id", "h", "vec_id", "d"]).astype({"query_id": "int64", "h": "int64", "vec_id": "int64", "d": "float64"})

    met = left.groupBy("part", "b", "q").cogroup(right.groupBy("part", "b", "q")).applyInPandas(meet, "query_id long, h long, vec_id long, d double")
    best = Window.partitionBy("query_id", "h").orderBy("d", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.sqrt("d").alias("score"))
