"""Token ids in binary shard files with a minimal perfect hash index.

Documents are dealt out by ranges of their key, sorted, encoded, and written as shards of bounded
size; shard follows shard in ascending key order.  A shard holds the raw ids (16 bits each if they
all fit, else 32), where each document begins, and a minimal perfect hash from its keys to its
documents: a key's bucket gives a displacement, hash and displacement give the slot, and the
fingerprint stored there tells the key from keys that are not in the shard.  Reading one document
takes a constant number of steps, whatever the size of the shard.

Files are written by Spark's own committer, so a lost task leaves no half file: a shard is one
row, whose bytes the text writer puts out as they are and ends with a line feed that the format
allows for.

Edge cases: null and empty texts hold the end id alone.  Rows that share a key are neighbours, in the
order of a hash of their texts, and all of them belong to the key; such a run may cross shards.
A null key sorts first and is found under None.  An empty table gives no file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgrid.llm import tokens
from rillgrid.session import ship

MAGIC = b"IDSHARD1"
HEAD = struct.Struct("<8sIIQQQQQQ")  # magic, part, number in the part, ids of the part before, width, documents, ids, keys, buckets
SHARD_IDS = 2_000_000  # ids after which a shard is closed
PER_BUCKET = 3  # keys of a bucket of the hash, on average


def _bytes_of(key: int | None) -> bytes:
    return b"" if key is None else struct.pack("<q", key)


def head_of(data: bytes) -> tuple:
    return HEAD.unpack_from(data)


def _slot(key: bytes, displacement: int, n: int) -> int:
    return xxhash.xxh64_intdigest(key, displacement) % n


def perfect_hash(keys: list[bytes]) -> np.ndarray:
    """Displacements by bucket that send the distinct ``keys`` to distinct slots 0 .. len(keys) - 1.

    Buckets are settled from the fullest down; a bucket of one key names its slot outright, as -1 - slot.
    """
    n = len(keys)
    buckets: list[list[bytes]] = [[] for _ in range(max(1, -(-n // PER_BUCKET)))]
    for k in keys:
        buckets[_slot(k, 0, len(buckets))].append(k)
    found, taken, free = np.zeros(len(buckets), dtype=np.int64), bytearray(n), 0
    for b in sorted(range(len(buckets)), key=lambda i: -len(buckets[i])):
        own = buckets[b]
        if len(own) == 1:
            while taken[free]:
                free += 1
            taken[free] = 1
            found[b] = -1 - free
        elif own:
            d = 1
            while True:
                slots = {_slot(k, d, n) for k in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
                d += 1
            for s in slots:
                taken[s] = 1
            found[b] = d
    return found


def slot_of(key: bytes, displacements: np.ndarray, n: int) -> int:
    d = int(displacements[_slot(key, 0, len(displacements))])
    return -1 - d if d < 0 else _slot(key, d, n)


def build(part: int, number: int, before: int, keys: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of a shard; ``keys`` come in order, equal keys next to one another."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    starts = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype="<u8")
    first = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
    own = [_bytes_of(keys[i]) for i in first]
    displacements = perfect_hash(own)
    slots, prints = np.zeros(len(own), dtype="<u4"), np.zeros(len(own), dtype="<u8")
    for i, k in zip(first, own, strict=True):
        s = slot_of(k, displacements, len(own))
        slots[s], prints[s] = i, xxhash.xxh64_intdigest(k, 1 << 40)
    held = np.array([k or 0 for k in keys], dtype="<i8")
    nulls = np.array([k is None for k in keys], dtype="u1")
    head = HEAD.pack(MAGIC, part, number, before, width, len(keys), len(flat), len(own), len(displacements))
    return b"".join([head, held.tobytes(), nulls.tobytes(), starts.tobytes(), displacements.astype("<i8").tobytes(), slots.tobytes(), prints.tobytes(), flat.astype(f"<u{width}").tobytes()])


@dataclass
class Shard:
    """A view of a shard's bytes."""

    part: int
    number: int
    before: int
    keys: np.ndarray
    nulls: np.ndarray
    starts: np.ndarray
    displacements: np.ndarray
    slots: np.ndarray
    prints: np.ndarray
    payload: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Shard:
        magic, part, number, before, width, docs, ids, keys, buckets = head_of(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, found = HEAD.size, []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs + 1), ("<i8", buckets), ("<u4", keys), ("<u8", keys), (f"<u{width}", ids)):
            found.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += found[-1].nbytes
        return cls(part, number, before, *found)

    def find(self, key: int | None) -> range:
        """Numbers of the documents with ``key``; empty if there are none."""
        raw = _bytes_of(key)
        s = slot_of(raw, self.displacements, len(self.slots))
        if self.prints[s] != xxhash.xxh64_intdigest(raw, 1 << 40):
            return range(0)
        first = end = int(self.slots[s])
        while end < len(self.keys) and (None if self.nulls[end] else int(self.keys[end])) == key:
            end += 1
        return range(first, end)

    def own_keys(self) -> list[int | None]:
        """The keys that the shard holds, each once."""
        keys = [None if z else int(k) for k, z in zip(self.keys.tolist(), self.nulls.tolist(), strict=True)]
        return [k for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]

    def ids(self, i: int) -> bytes:
        """Ids of document ``i`` as little-endian unsigned 32-bit integers."""
        return self.payload[int(self.starts[i]) : int(self.starts[i + 1])].astype("<u4").tobytes()


def write(docs: DataFrame, spec: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write them as shards under ``path``, in ascending order of the integer ``key``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, number = tokens.encoder(shared.value, end_id), TaskContext.get().partitionId(), 0
        before = 0
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = 0
        for batch in batches:
            for k, found in zip(batch["key"].tolist(), encoder.encode(batch["text"]), strict=True):
                keys.append(None if k is None else int(k))
                ids.append(found)
                size += len(found) // 4
                if size >= shard_ids:
                    yield pd.DataFrame({"shard": [build(part, number, before, keys, ids)]})
                    keys, ids, size, number, before = [], [], 0, number + 1, before + size
        if keys:
            yield pd.DataFrame({"shard": [build(part, number, before, keys, ids)]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = taken.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")
    shards = dealt.select(F.col("key").cast("string").alias("key"), "text").mapInPandas(run, "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard from its head: part, number, n_docs, n_ids, and ``before``, the ids of its part before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [head_of(bytes(h)) for h in batch["head"]]
            yield pd.DataFrame([(r[1], r[2], r[5], r[6], r[3]) for r in rows], columns=["part", "number", "n_docs", "n_ids", "before"])

    heads = _files(spark, path).select(F.substring("content", 1, HEAD.size).alias("head"))
    return heads.mapInPandas(run, "part int, number int, n_docs long, n_ids long, before long")


def _found(spark: SparkSession, path: str, key: str, wanted) -> DataFrame:
    """Documents of the shards with the keys that ``wanted`` names for a shard."""
    totals = directory(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per range of the write
    bases, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        bases[row["part"]] = at
        at += row["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                shard = Shard.of(content)
                base = bases[shard.part] + shard.before
                found = [(k, i) for k in wanted(shard) for i in shard.find(k)]
                for at in range(0, len(found), 2000):
                    some = found[at : at + 2000]
                    yield pd.DataFrame({"key": [None if k is None else str(k) for k, _ in some], "start": [base + int(shard.starts[i]) for _, i in some], "ids": [shard.ids(i) for _, i in some]})

    found = _files(spark, path).select("content").mapInPandas(run, "key string, start long, ids binary")
    return found.select(F.col("key").cast("long").alias(key), "start", "ids")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """All documents of the shards under ``path``: key, start (ids of all documents before it), ids.

    Each key of a shard is looked up by the shard's hash, so a document comes back only if index,
    fingerprint and offsets agree.
    """
    return _found(spark, path, key, Shard.own_keys)


def lookup(spark: SparkSession, path: str, keys: list[int | None], key: str = "doc_id") -> DataFrame:
    """The documents with ``keys``, a list that the caller holds, from the shards that have them."""
    wanted = list(dict.fromkeys(keys))
    return _found(spark, path, key, lambda shard: wanted)
