"""Product codes of vectors: each of ``PARTS`` equal parts is replaced by the number of its nearest codebook entry.

Components become whole numbers, floor(``SCALE`` * x).  Codebooks start as the parts of the vectors with the smallest ids and are refined
by ``ROUNDS`` rounds of assignment and floored means; all distances that decide anything are whole numbers, so results do
not depend on partitions or machines.

Assignment keeps Drake and Hamerly's adaptive bounds.  With each part of each vector a written table carries its entry, the
``b`` next closest entries in order with a lower bound of the distance to each, and one bound for all entries outside the list.
After the codebooks moved, a listed bound falls by its own entry's move and the outer bound by the largest move.  An entry whose
distance, computed anew, lies below all bounds stays; if it lies below the outer bound only the list is looked at, with whole-number distances; else
all entries are.  ``b`` starts at a 16th of the entries and then follows, for each part, how deep the lists were needed.  Bounds are
floating point, kept apart from whole-number distances by a margin, and decide only which entries are computed.  A row of the
table takes about as much room as its vector.

A round is one pass over the table, which writes the new table and, next to its rows, each task's sums by entry; these are
added up on Spark and the driver gets one row per entry.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do those of another length than that of most
vectors (the longer one in a tie), nor those with a component of ``LARGEST`` or more in size, whose squared distances would leave 64 bits.  A length that ``PARTS``
does not divide is filled up with zeros.  A null id keeps its null and comes last when codebooks start; equal ids are ordered by vector.  Repeated
rows are coded one by one.  With fewer vectors than entries the codebooks are as small.  Other columns, whatever their names, are ignored.  A label's
error that leaves 64 bits is null.  An empty table gives no rows and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.llm.common import hinted
from rillgrid.session import ship
from rillgrid.staging import release, settle

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 65_536.0
MARGIN = 1e-6  # relative, of bounds
LONGEST, SHORTEST = 16, 64  # a list holds at most and at least this part of the entries
NOTHING = 1e38  # bounds beyond it mark places of a list that hold no entry
_BLOCK = 4_096  # vectors whose distances to all entries are held at a time
_STATE = "id long, label string, vec binary, code binary, near binary, low binary, error long"
_SUMS = "part int, entry int, n long, sums array<bigint>, depth array<bigint>"


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Whole-number squared distances of all ``points`` to all ``centers``."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(centers).max(initial=0)))
    if points.shape[1] * (2 * top) ** 2 < 1 << 53:  # every step is then exact in floating point, which multiplies faster
        p, c = points.astype(np.float64), centers.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centers], axis=1)


def _listed(points: np.ndarray, centers: np.ndarray, near: np.ndarray) -> np.ndarray:
    return np.stack([((points - centers[near[:, j]]) ** 2).sum(axis=1) for j in range(near.shape[1])], axis=1) if near.shape[1] else np.zeros((len(points), 0), dtype=np.int64)


def _ordered(distance: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order of each row's entries by distance, then number."""
    return np.lexsort((number, distance), axis=1)


def _below(distance: np.ndarray) -> np.ndarray:
    return np.sqrt(distance.astype(np.float64)) * (1 - MARGIN)


def _rounded_down(bounds: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.nextafter(bounds.astype("<f4"), np.float32(-np.inf)))


def search_all(points: np.ndarray, centers: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, the ``b`` next entries in order, bounds of these and of all others), from all distances."""
    n, k = len(points), len(centers)
    entry, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    near, low = np.zeros((n, b), dtype=np.int64), np.full((n, b + 1), np.inf)
    for at in range(0, n, _BLOCK):
        distance = squared(points[at : at + _BLOCK], centers)
        order = _ordered(distance, np.broadcast_to(np.arange(k), distance.shape))[:, : b + 2]
        found = np.take_along_axis(distance, order, axis=1)
        here = slice(at, at + len(distance))
        entry[here], best[here], near[here] = order[:, 0], found[:, 0], order[:, 1 : b + 1]
        low[here, : found.shape[1] - 1] = _below(found[:, 1:])
    return entry, best, near, low


def search_bounded(points: np.ndarray, centers: np.ndarray, entry: np.ndarray, near: np.ndarray, low: np.ndarray, moves: np.ndarray, b: int):
    """As ``search_all``, from the last round's entries, lists and bounds and how far each entry has moved; and how deep each list was needed."""
    width = near.shape[1]
    low = low.copy()
    low[:, :width] -= moves[near]
    low[:, width] -= moves.max(initial=0.0)
    low -= np.where(low < NOTHING, np.abs(low) * MARGIN, 0.0)
    best = ((points - centers[entry]) ** 2).sum(axis=1)
    upper = np.sqrt(best.astype(np.float64)) * (1 + MARGIN) + MARGIN
    depth = width + 1 - (np.minimum.accumulate(low[:, ::-1], axis=1) > upper[:, None]).sum(axis=1)  # bounds up to which entries may be closer or as close
    rest = np.flatnonzero((depth > 0) & (depth <= width))
    if len(rest):
        number = np.concatenate((entry[rest, None], near[rest]), axis=1)
        held = low[rest, :width] < NOTHING
        distance = np.concatenate((best[rest, None], np.where(held, _listed(points[rest], centers, near[rest]), np.iinfo(np.int64).max)), axis=1)
        order = _ordered(distance, number)
        number, distance = np.take_along_axis(number, order, axis=1), np.take_along_axis(distance, order, axis=1)
        entry[rest], best[rest], near[rest], low[rest, :width] = number[:, 0], distance[:, 0], number[:, 1:], np.where(distance[:, 1:] == np.iinfo(np.int64).max, np.inf, _below(distance[:, 1:]))
    if b < width:  # the outer bound takes over what leaves the list
        low = np.concatenate((low[:, :b], low[:, b:].min(axis=1, keepdims=True)), axis=1)
        near = near[:, :b]
    elif b > width:  # the list grows where all distances are computed again; until then its new places hold nothing
        near = np.concatenate((near, np.repeat(entry[:, None], b - width, axis=1)), axis=1)
        low = np.concatenate((low[:, :width], np.full((len(low), b - width), np.inf), low[:, width:]), axis=1)
    whole = np.flatnonzero(depth > width)
    if len(whole):
        entry[whole], best[whole], near[whole], low[whole] = search_all(points[whole], centers, b)
    return entry, best, near, low, depth


def whole(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vec) of the ``vectors`` that take part, as whole numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    taken = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), v.alias("v"))
    taken = taken.where(F.size("v") > 0).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    lengths = taken.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else PARTS
    width = -(-d // PARTS) * PARTS
    numbers = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return taken.where(F.size("v") == d).select("id", "label", F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), width - d)).alias("vec"))


def _first_codebooks(rows: DataFrame) -> np.ndarray:
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    vecs = np.array([r["vec"] for r in first], dtype=np.int64)
    return vecs.reshape(len(vecs), PARTS, -1).swapaxes(0, 1) if len(vecs) else np.zeros((PARTS, 0, 0), dtype=np.int64)


def _pass(table: DataFrame, books: np.ndarray, moves: np.ndarray | None, depth: list[int], again: list[int]) -> DataFrame:
    """Rows with their entries under ``books``, and the tasks' sums by entry; lists are ``depth`` long before and ``again`` long after."""
    k = books.shape[1]
    entries = np.uint8 if k <= 256 else np.uint16
    starts, ends = np.cumsum([0, *depth]), np.cumsum([0, *again])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, sums = np.zeros((PARTS, k), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        needed = [np.zeros(d + 2, dtype=np.int64) for d in depth]
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            vec = np.frombuffer(b"".join(batch["vec"]), dtype="<i4").reshape(n, PARTS, -1).astype(np.int64)
            code, error = np.zeros((n, PARTS), dtype=entries), np.zeros(n, dtype=np.int64)
            lists, bounds = [], []
            if moves is not None:
                old = np.frombuffer(b"".join(batch["code"]), dtype=entries).reshape(n, PARTS)
                close = np.frombuffer(b"".join(batch["near"]), dtype=entries).reshape(n, -1)
                limit = np.frombuffer(b"".join(batch["low"]), dtype="<f4").reshape(n, -1).astype(np.float64)
            for p in range(PARTS):
                if moves is None:
                    entry, best, near, low = search_all(vec[:, p], books[p], again[p])
                else:
                    entry, best, near, low, deep = search_bounded(
                        vec[:, p], books[p], old[:, p].astype(np.int64), close[:, starts[p] : starts[p + 1]].astype(np.int64), limit[:, starts[p] + p : starts[p + 1] + p + 1], moves[p], again[p]
                    )
                    needed[p] += np.bincount(deep, minlength=depth[p] + 2)
                code[:, p], error = entry, error + best
                lists.append(near.astype(entries))
                bounds.append(low)
                count[p] += np.bincount(entry, minlength=k)
                np.add.at(sums[p], entry, vec[:, p])
            near, low = np.ascontiguousarray(np.concatenate(lists, axis=1)), _rounded_down(np.concatenate(bounds, axis=1))
            made = {"id": batch["id"], "label": batch["label"], "vec": batch["vec"], "code": [x.tobytes() for x in code], "near": [x.tobytes() for x in near], "low": [x.tobytes() for x in low], "error": error}
            yield pd.DataFrame(made).assign(part=None, entry=None, n=None, sums=None, depth=None)
        nothing = dict.fromkeys(("id", "label", "vec", "code", "near", "low", "error"))
        out = [nothing | {"part": p, "entry": e, "n": count[p, e], "sums": sums[p, e], "depth": None} for p in range(PARTS) for e in np.flatnonzero(count[p]).tolist()]
        out += [nothing | {"part": p, "entry": -1, "n": None, "sums": None, "depth": needed[p]} for p in range(PARTS) if moves is not None and needed[p].any()]
        if out:
            yield pd.DataFrame(out)

    return table.mapInPandas(run, f"{_STATE}, {_SUMS}")


def _added(sums: DataFrame, column: str, n: int, *keys: str) -> DataFrame:
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(n)]).alias(column))


def _depths(table: DataFrame, depth: list[int], k: int) -> list[int]:
    """Lists as long as nine of ten searches inside them needed; twice as long where most searches went beyond them."""
    found = {r["part"]: [x or 0 for x in r["depth"]] for r in _added(table.where("entry = -1"), "depth", max(depth) + 2, "part").collect()}
    out = []
    for p, d in enumerate(depth):
        needed = np.array(found.get(p, [0] * (d + 2))[1 : d + 2], dtype=np.int64)
        inside = np.cumsum(needed[:d])
        most = 2 * d if needed.sum() and 2 * needed[d] > needed.sum() else int(np.searchsorted(inside, 0.9 * inside[-1])) + 1 if d else 0
        out.append(min(max(most, k // SHORTEST, 1), max(1, k // LONGEST), max(0, k - 2)))
    return out


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(coded rows, codebooks): id, label, code (a byte per part), error; and the final entries by part, entry and component."""
    spark = vectors.sparkSession
    ship(spark)
    rows = whole(vectors, key, vector, label)
    books = _first_codebooks(rows)
    k = books.shape[1]
    to_bytes = F.pandas_udf(lambda vecs: pd.Series([np.asarray(v, dtype="<i4").tobytes() for v in vecs], dtype=object), "binary")
    table = settle(rows.select("id", "label", to_bytes("vec").alias("vec")), "whole")
    if not k:
        return table.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    depth = [min(max(1, k // LONGEST), max(0, k - 2))] * PARTS
    moves, again = None, depth
    for done in range(ROUNDS + 1):
        new = settle(_pass(table, books, moves, depth, again), "codes")
        release(spark, table)
        table = new.where("part IS NULL").select("id", "label", "vec", "code", "near", "low", "error")
        if done == ROUNDS:
            break
        after = books.copy()
        for r in _added(new.where("entry >= 0"), "sums", books.shape[2], "part", "entry").collect():  # one row per entry
            after[r["part"], r["entry"]] = np.array(r["sums"], dtype=np.int64) // r["n"]
        moves = np.sqrt(((after - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + MARGIN)
        books = after
        depth, again = again, _depths(new, depth, k) if done else again
    return table.select("id", "label", "code", "error"), books


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector that takes part: key, code (two hexadecimal digits per part), error, label_error, codebooks_sha256."""
    coded, books = fit(vectors, key, vector, label)
    by_label = settle(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "labels")
    whole_books = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(hinted(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").cast(vectors.schema[key].dataType.simpleString()).alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(whole_books).alias("codebooks_sha256"))
