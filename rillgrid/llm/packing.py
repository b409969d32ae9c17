"""Best-fit-decreasing packing of token sequences.

Documents are encoded, ended with an end id, and cut into pieces of at most ``capacity`` ids; of a
document that is cut, the first piece is the short one.  Each task packs its own documents in
chunks: pieces go from the longest to the shortest into the open sequence with the least room that
still holds them, found by walking a segment tree over the possible remaining capacities, so a
piece costs the logarithm of the capacity.  Nothing is shuffled.  A chunk holds thousands of
sequences, so what its last open sequences leave empty is a small share; input that lies in
partitions of only a few sequences should be coalesced first.

Edge cases: null and empty texts are documents of the end id alone.  Repeated rows are packed as
often as they stand in the table.  A document without an id keeps its null.  Pieces of equal length
are placed in the order of the input.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillgrid.llm import tokens
from rillgrid.session import ship

CHUNK = 8_000_000  # ids packed together by a task: 32 MB
BATCH = 4_000_000  # ids in an output batch


class CapacityTree:
    """Counts of open sequences by remaining capacity, in a segment tree."""

    def __init__(self, capacity: int):
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        count, at = self.count, need + self.width
        if count[at]:
            return need
        while at > 1:  # up to the first right neighbour that has any, then down to its least
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length its sequence and its offset there, and the number of sequences."""
    tree = CapacityTree(capacity)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room is None:
            room, number = capacity, used
            used += 1
        else:
            number = open_at[room].pop()
            tree.add(room, -1)
        where[i], offset[i] = number, capacity - room
        if room > need:
            open_at[room - need].append(number)
            tree.add(room - need, 1)
    return where, offset, used


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pack(docs: DataFrame, spec: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of ``docs``: key, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    ``spec`` is the content of a tokenizer file.  Sequence ids hold the number of the task in their upper bits.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(shared.value, end_id)
        made = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # key, piece, start, ids
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal made, held, size
            lengths = np.array([len(x[3]) // 4 for x in held], dtype=np.int64)
            where, offset, used = best_fit_decreasing(lengths, capacity)
            step = BATCH // capacity
            for at in range(0, len(held), step):
                part = held[at : at + step]
                out = pd.DataFrame(part, columns=[key, "piece", "start", "ids"])
                out["length"], out["sequence_id"], out["offset"] = lengths[at : at + step], where[at : at + step] + made, offset[at : at + step]
                yield out[[key, "piece", "start", "length", "ids", "sequence_id", "offset"]]
            made += used
            held, size = [], 0

        for batch in batches:
            for k, ids in zip(batch[key].tolist(), encoder.encode(batch[text]), strict=True):
                for piece, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    held.append((k, piece, start, ids[4 * start : 4 * (start + n)]))
                    size += n
                    if size >= CHUNK:
                        yield from flush()
        if held:
            yield from flush()

    of_key = docs.schema[key].dataType.simpleString()
    # the id as text on the way in, so that a null does not turn 64-bit ids into floating point
    taken = docs.select(docs[key].cast("string").alias(key), docs[text].alias(text))
    schema = f"`{key}` string, piece int, start long, length long, ids binary, sequence_id long, offset long"
    packed = taken.mapInPandas(run, schema)
    return packed.select(packed[key].cast(of_key).alias(key), "piece", "start", "length", "ids", "sequence_id", "offset")
