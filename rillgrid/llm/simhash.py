"""SimHash groups of documents whose fingerprints differ in few bits.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's word
shingles, repeats included.  Fingerprints link at ``RADIUS`` or fewer differing bits.  They are cut
into two segments of 32 bits: of two linked fingerprints one segment differs by at most one bit, so
they share a variant of that segment with one bit deleted.  Each distinct fingerprint is listed
under its 64 variants, equal variants are joined, and the pairs are verified on all bits.

Most variants hold one or two fingerprints, and an aggregation with a minimum and a maximum gives
the pair.  Variants with up to ``BUCKET`` are joined.  For the fingerprints of fuller variants
there is an exact way without pairs: two fingerprints differ by at most two bits just if some 64-bit
value is within one bit of both, so each is listed under the 65 values within one bit, and all that
share a value link to the smallest there.  Components are found on distinct fingerprints by
large-star and small-star rounds, each written to the shared folder.

Edge cases: a null or blank text has fingerprint 0 and is linked like any other; fewer words than
a shingle make one shingle of all words.  Repeated rows share a fingerprint and so a component.
A null id counts as larger than all others; a component of only null ids has the id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.llm import minhash
from rillgrid.llm.common import components
from rillgrid.session import ship
from rillgrid.staging import settle

SHINGLE = 3
SEED = 42
RADIUS = 2
BUCKET = 4  # fingerprints of a variant that are paired off; fuller ones take the exact other way
_SLAB = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text as an unsigned integer."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z is lower-cased, only ASCII space separates
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = len(words) - size + 1
    begins = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[size - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLAB):
        hashes = np.fromiter((digest(joined[b:e], seed) for b, e in zip(begins[at : at + _SLAB], ends[at : at + _SLAB], strict=True)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit column."""

    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([x - (1 << 64) if (x := fingerprint(t, size)) >> 63 else x for t in batch], dtype="int64")

    return of(F.col(f"`{text}`"))


def _variants(fp: Column) -> Column:
    """64 keys: segment and deleted bit in the upper half, the segment without that bit in the lower."""
    low, high = F.expr("fp & 4294967295L"), F.shiftrightunsigned(fp, 32)
    keys = []
    for number, segment in enumerate((low, high)):
        for bit in range(32):
            mask = 0xFFFFFFFF ^ (1 << bit)
            keys.append(segment.bitwiseAND(F.lit(mask)) + F.lit((number * 32 + bit) << 32))
    return F.array(*keys)


def _near(a: str, b: str, radius: int = RADIUS) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of column ``fp`` that connect whatever is linked by at most two differing bits."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by variant once: the counts and the join with them work on the same partitions, and only
    # the rows of variants that hold more than one fingerprint leave the stage
    listed = distinct.select("fp", F.explode(_variants(F.col("fp"))).alias("key")).repartition(parts, "key")
    counts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    several = settle(listed.join(counts.hint("merge"), "key"), "several")
    # the greater one of a pair stands for it
    twos = several.where("n = 2 AND fp = b").select(F.col("a").alias("u"), F.col("b").alias("v")).where(_near("u", "v"))
    small = several.where(F.col("n").between(3, BUCKET)).select("key", "fp")
    paired = (
        small.select("key", F.col("fp").alias("u")).join(small.select("key", F.col("fp").alias("v")), "key")
        .where((F.col("u") < F.col("v")) & _near("u", "v")).select("u", "v")
    )
    crowded = several.where(F.col("n") > BUCKET).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    stars = settle(crowded.select("fp", F.explode(around).alias("near")), "near")
    heads = stars.groupBy("near").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    starred = stars.join(heads, "near").where("u < fp").select("u", F.col("fp").alias("v"))
    return twos.union(paired).union(starred).distinct()


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row of ``docs``; the component's id is its smallest key."""
    marked = settle(docs.select(docs[key].alias("_k"), fingerprints(docs, text).alias("fp")), "prints")
    least = marked.groupBy("fp").agg(F.min("_k").alias("_k"))
    rooted = settle(_rooted(least, marked), "rooted")
    names = rooted.groupBy("root").agg(F.min("_k").alias("component_id"))
    named = settle(rooted.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(F.col("_k").alias(key), "fp", "component_id")


def _rooted(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` with the root of their fingerprint's component among all fingerprints of ``marked``."""
    distinct = marked.select("fp").distinct()  # equal ones meet before the shuffle
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, fingerprint (16 hexadecimal digits), component_id (smallest key reachable)."""
    return grouped(docs, key, text).select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def proposed(marked: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes of ``marked`` (node, mark) that SimHash takes for near copies, as few as connect them.

    Nodes of one fingerprint meet its smallest node, and of linked fingerprints the smallest nodes meet.
    """
    prints = settle(marked.select("node", F.col("mark").alias("fp")), "prints")
    heads = settle(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    linked = links(heads.select("fp"))
    for x in "uv":
        linked = linked.join(heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")), x)
    return settle(equal.union(linked.where("head_u <> head_v").select("head_u", "head_v")), "proposed")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest key, then the smallest hash of the row.

    SimHash over the stage's shingles proposes pairs, which are verified on the whole sets; the rest of the copies, whose fingerprints differ in
    more bits, are found by ``minhash``, whose links decide what a copy is.
    """
    scheme = minhash.SCHEMES["stage"]
    found = minhash.copies(docs, scheme, key, text, fingerprints(docs, text, scheme.shingle), proposed)
    placed = found.sets.select("node", "place").join(found.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = settle(placed.groupBy("root").agg(F.min("place").alias("place")).select("place.k", "place.r"), "kept")
    own = F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("own"))
    same = F.col("own.k").eqNullSafe(F.col("k")) & (F.col("own.r") == F.col("r"))
    left = whole.join(kept, same, "left_semi")
    # rows alike in all columns share key and hash; one of them stays
    again = settle(found.rows.groupBy("k", "r").count().where("count > 1").select("k", "r").join(kept, ["k", "r"], "left_semi"), "again")
    if again.take(1):
        left = left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates(["own"]))
    return left.select("row.*")
