"""Near copies by MinHash: texts whose sets of word shingles have a Jaccard similarity of at least ``percent`` / 100.

A signature holds ``PLACES`` minima of the set under as many permutations, ``16`` bits of each.  At similarity s a place differs with probability
1 - s, so signatures of linked texts lie within a Hamming distance (differing places) of ``limit`` but for a share given in ``SCHEMES``.
The join is a multi-index: a signature is cut into c chunks, and of two signatures at a distance of at most ``limit`` = 2c - 1 some
chunk differs in at most one place (pigeonhole).  Each chunk is therefore listed once for each of its places, with that place
left out, and equal lists meet: no pair within the limit is lost.  What meets is verified on the whole sets, so links are exact.

Groups of near copies and texts around one common passage would make the lists quadratic.  Three things prevent that, none of which loses a link:

* Texts with equal sets are one node.
* Sets of n and m shingles that are linked share at least (n + m) * percent / (100 + percent) of them, and none of those that a set has alone among all listed
  nodes (an aggregation by shingle).  A node that cannot share that much with any set, or with the smallest of a list, leaves before pairs are made,
  and pairs are made under this condition.
* Only whether texts are connected is asked.  In each list all nodes are held against its head, the one with the fewest own shingles.  Lists with one head
  are one group from there on, whose nodes are known by the shingles in which they differ from the head.  As long as a group holds several components, some
  nodes outside its largest one (about ``WIDER`` ** 2, then ``WIDER`` times as many in each round) are held against the nodes of other components there and
  leave the group.  Pairs are made by common shingles of the differences, and only of those that come early enough (``_unlike``): nodes that merely resemble
  the head share few of them.  Nodes that are linked already are not compared, and a node that matched stays in its other groups, so members that only reach
  others through it are found.

Edge cases: words are separated by ASCII white space and A-Z is lower-cased; fewer words than a shingle make one
shingle of all words; null and blank texts have the empty set, which is linked with nothing.  Repeated rows share a set.  A null id is no component's smallest
id unless all ids are null, and then the component is null.  Columns besides id and text only tell rows apart.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.llm.common import components, hinted
from rillgrid.session import ship
from rillgrid.staging import release, settle

PLACES = 64
WIDER = 8
_SLAB = 1 << 12  # shingles whose permuted values are held at a time
_draw = np.random.default_rng(42).integers(0, 1 << 64, size=(2, PLACES), dtype=np.uint64)
_FACTOR, _SHIFT = (_draw[0] | np.uint64(1))[:, None], _draw[1][:, None]
_WORDS = np.random.default_rng(43).integers(0, 1 << 64, size=64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Scheme(NamedTuple):
    """Words of a shingle, least similarity in percent, chunks of a signature."""

    shingle: int = 3
    percent: int = 85
    chunks: int = 12

    @property
    def limit(self) -> int:
        return 2 * self.chunks - 1

    def places(self) -> list[list[int]]:
        """The places of each chunk."""
        return [x.tolist() for x in np.array_split(np.arange(PLACES), self.chunks)]


# at exactly the least similarity a pair's signatures lie beyond the limit in 1.5 of 100,000 cases (85 %) and 1 of 100,000 (80 %)
SCHEMES = {"op11": Scheme(), "stage": Scheme(5, 80, 14)}


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a whole text."""
    words = text.encode().lower().split() if text else []
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out += hashes[i : i + n] * _WORDS[i]
    for _ in range(2):
        out ^= out >> np.uint64(33)
        out *= _MIX
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each minimum of a set."""
    least = np.full(PLACES, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(found), _SLAB):
        least = np.minimum(least, (found[None, at : at + _SLAB] * _FACTOR + _SHIFT).min(axis=1))
    return ((least * _MIX) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def sketch(docs: DataFrame, size: int, text: str = "text") -> Column:
    """(node, n, sig): a digest of the set of shingles, its size and its signature."""
    ship(docs.sparkSession)

    @F.pandas_udf("node binary, n long, sig array<smallint>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingles(t, size) for t in batch]
            yield pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "sig": [signature(s) for s in sets]})

    return of(F.col(f"`{text}`"))


def _whole(text: str, size: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingles(t, size).view(np.int64) for t in batch], dtype=object)

    return of(F.col(text))


def lists(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, node) for the lists that hold several nodes of ``sets`` (node, sig)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.array(*[F.xxhash64(F.lit(p), *[F.get("sig", F.lit(q)) for q in chunk if q != p]) for chunk in scheme.places() for p in chunk])
    # dealt out by list once: the counts and the join with them work on the same partitions
    return _several(sets.select("node", F.explode(keys).alias("key")).repartition(parts, "key"))


def _several(listed: DataFrame) -> DataFrame:
    counts = listed.groupBy("key").count().where("count > 1").select("key")
    return settle(listed.join(counts.hint("merge"), "key", "left_semi").select("key", *[c for c in listed.columns if c != "key"]), "lists")


def _supported(listed: DataFrame, whole: DataFrame, scheme: Scheme) -> DataFrame:
    """``listed`` (key, node) without the nodes that cannot link in a list, with each node's ``n`` and ``own``, its shingles that no other listed node has."""
    # one of a shingle's nodes stands for it; where it is the only one, that is its own
    name = [F.xxhash64("node").alias("a"), F.hash("node").alias("b")]
    seen = whole.select(*name, F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.first("a").alias("a"), F.first("b").alias("b"))
    alone = seen.where("c = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("own"))
    known = whole.select("node", "n", *name).join(alone, ["a", "b"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    kept = settle(known.where(100 * (F.col("n") - F.col("own")) >= scheme.percent * F.col("n")).select("node", "n", "own"), "kept")
    several = _several(listed.join(kept, "node").select("key", "node", "n", "own"))
    least = several.groupBy("key").agg(F.min("n").alias("least"))
    # what a node shares at most is too little for the smallest set of the list, so for every one
    enough = (100 + scheme.percent) * (F.col("n") - F.col("own")) >= scheme.percent * (F.col("n") + F.col("least"))
    return _several(several.join(least.hint("merge"), "key").where(enough).drop("least"))


def _compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with their sizes and the size of what they share."""
    u, v = (whole.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "hashes")]) for x in "uv")
    # by merging: a node that many are compared with is then dealt anew as a skewed key
    met = pairs.join(v.hint("merge"), "v").join(u.hint("merge"), "u")
    return met.select("u", "v", "n_u", "n_v", F.size(F.array_intersect("hashes_u", "hashes_v")).alias("both"))


def _matching(pairs: DataFrame, whole: DataFrame, scheme: Scheme) -> DataFrame:
    """The ``pairs`` (u, v) whose sets are similar enough."""
    enough = 100 * F.col("both") >= scheme.percent * (F.col("n_u") + F.col("n_v") - F.col("both"))
    return settle(_compared(pairs, whole).where(enough).select("u", "v"), "matching")


def _unlike(rest: DataFrame, whole: DataFrame, scheme: Scheme) -> DataFrame:
    """``rest`` with each node's ``n``, the number ``m`` of shingles that either it or its group's head has, and ``diff``, those of them by which it can be found.

    Of two nodes x and y, those in which they differ are just those that one of the two differences holds and the other does not, so a link asks that the
    differences have (more * (m_x + m_y) - less * (n_x + n_y)) / (2 * more) shingles in common.  In one order of all shingles the first one they share has
    that many places from its own to the end, in both.  Where x and y have different roots, one of them is not linked with the head, and the number is at
    least 1; ``diff`` is cut where it is for every such partner.  Shingles that the head lacks come first, as they are rarer.
    """
    more, less = 100 + scheme.percent, 100 - scheme.percent
    heads = whole.select(F.col("node").alias("key"), F.col("n").alias("n_"), F.col("hashes").alias("hashes_"))
    met = rest.join(whole.select("node", "n", "hashes").hint("merge"), "node").join(heads.hint("merge"), "key")
    diff = F.concat(F.array_except("hashes", "hashes_"), F.array_except("hashes_", "hashes"))
    sized = met.select(*rest.columns, "n", "n_", diff.alias("diff")).withColumn("m", F.size("diff").cast("long"))
    m, n, n_ = F.col("m"), F.col("n"), F.col("n_")
    beyond = more * m - less * (n + n_)  # positive where the node is not linked with the head
    least = F.ceil(F.when(beyond > 0, beyond / (more + less)).otherwise((more * m + less * (n_ - n) + 1) / (2 * more)))
    return sized.select(*rest.columns, "n", "m", F.slice("diff", F.lit(1), (m - least + 1).cast("int")).alias("diff"))


def _meeting(rest: DataFrame, pivots: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (u, v) of a node of ``pivots`` and one of ``rest`` in the same group with another root, as far as their differences from the head and their own shingles allow a link."""
    more, less = 100 + scheme.percent, 100 - scheme.percent
    spread = lambda x: x.select("key", "node", "root", "own", "n", "m", F.posexplode("diff").alias("at", "h"))
    a, b = spread(rest), spread(pivots)
    b = b.select(*[F.col(c).alias(f"{c}_") for c in b.columns])
    left = F.least(F.col("m") - F.col("at"), F.col("m_") - F.col("at_"))
    enough = 2 * more * left >= more * (F.col("m") + F.col("m_")) - less * (F.col("n") + F.col("n_"))
    # both sets share at most what they have in common with any other
    shared = F.least(F.col("n") - F.col("own"), F.col("n_") - F.col("own_"))
    enough = enough & (more * shared >= scheme.percent * (F.col("n") + F.col("n_")))
    met = (F.col("key") == F.col("key_")) & (F.col("h") == F.col("h_")) & (F.col("root") != F.col("root_")) & enough
    return settle(a.join(b.hint("merge"), met).select(*_pairs(F.col("node"), F.col("node_"))).distinct(), "pairs")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def links(sets: DataFrame, texts: Callable[[DataFrame], DataFrame], scheme: Scheme, proposed: DataFrame | None = None) -> DataFrame:
    """Pairs (u, v) of linked nodes of ``sets`` (node, n, sig) that connect whatever is linked; ``texts`` gives (node, text) for a table of nodes.

    Pairs that another method has ``proposed`` are verified first, with those of the lists' heads; what they link is not compared again.
    """
    spark = sets.sparkSession
    listed = lists(sets.where("n > 0"), scheme)
    bodies = texts(listed.select("node").distinct()).select("node", _whole("text", scheme.shingle).alias("hashes"))
    # rows alike in all columns have the same text
    bodies = bodies.groupBy("node").agg(F.first("hashes").alias("hashes"))
    whole = settle(bodies.join(sets.select("node", "n"), "node"), "whole")
    rest = _supported(listed, whole, scheme)
    # once more, as what a node shares with those that left is its own now
    rest = _supported(rest.select("key", "node"), whole.join(rest.select("node").distinct(), "node", "left_semi"), scheme)
    heads = rest.groupBy("key").agg(F.min(F.struct(F.col("own") / F.col("n"), "node"))["node"].alias("head"))
    headed = settle(rest.join(heads.hint("merge"), "key"), "headed")
    first = headed.where("node <> head").select(*_pairs(F.col("node"), F.col("head")))
    found = _matching((first if proposed is None else first.union(proposed.select(*_pairs(F.col("u"), F.col("v"))))).distinct(), whole, scheme)
    before, rest, wide = rest, settle(headed.select(F.col("head").alias("key"), "node", "own").distinct(), "rest"), WIDER * WIDER
    release(spark, listed, headed, before)
    while True:
        placed, open_ = _open(rest, found)
        release(spark, rest)
        if not open_.take(1):
            return found
        inside = placed.join(open_.hint("merge"), "key")
        rest = settle(inside if "diff" in inside.columns else _unlike(inside, whole, scheme), "rest")
        pivots = rest.where((F.col("root") != F.col("main")) & (F.pmod(F.xxhash64("key", "node"), F.col("others")) < wide))
        new = _meeting(rest, pivots, scheme)
        matching, before = _matching(new, whole, scheme), [placed, open_, rest, new, found]
        found = settle(found.union(matching), "matching")
        rest = settle(rest.join(pivots.select("key", "node"), ["key", "node"], "left_anti").select("key", "node", "own", "n", "m", "diff"), "rest")
        release(spark, matching, *before)
        wide *= WIDER


def _open(rest: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rest`` (key, node, ...) with the nodes' roots, and (key, main, others) of the groups with several: the most frequent root, and how many nodes have another."""
    roots = settle(components(found), "roots")
    placed = settle(rest.join(roots, "node", "left").select(*rest.columns, F.coalesce("root", "node").alias("root")), "placed")
    inside = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    groups = inside.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    release(rest.sparkSession, roots)
    return placed, settle(groups.select("key", F.col("top.root").alias("main"), (F.col("c") - F.col("top.c")).alias("others")), "open")


class Copies(NamedTuple):
    """``rows`` (k, r, node, n) of a table, k its key and r a hash of the whole row; ``sets`` (node, place, n, sig); ``roots`` (node, root) of linked nodes."""

    rows: DataFrame
    sets: DataFrame
    roots: DataFrame


def copies(docs: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text", mark: Column | None = None, propose: Callable[[DataFrame], DataFrame] | None = None) -> Copies:
    """The components of near copies among ``docs``; ``propose`` may give pairs (u, v) to be verified from (node, mark), the ``mark`` of each text."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(F.col(f"`{key}`").alias("k"), row.alias("r"), sketch(docs, scheme.shingle, text).alias("s"), (F.lit(None) if mark is None else mark).cast("long").alias("mark"))
    rows = settle(found.select("k", "r", "s.node", "s.n", "s.sig", "mark"), "sketches")
    place = F.struct(F.col("k").isNull().alias("none"), "k", "r")
    sets = settle(rows.groupBy("node").agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sets")
    # texts with one set may have several marks
    proposed = None if propose is None else propose(rows.where("n > 0").select("node", "mark").distinct())
    # the texts are read again, for those that are asked for only
    bodies = docs.select(F.col(f"`{key}`").alias("k_"), row.alias("r_"), F.col(f"`{text}`").alias("text"))

    def texts(asked: DataFrame) -> DataFrame:
        first = settle(sets.select("node", "place.k", "place.r").join(asked, "node"), "first")
        return bodies.join(hinted(first, first.count()), F.col("k_").eqNullSafe(F.col("k")) & (F.col("r_") == F.col("r"))).select("node", "text")

    return Copies(rows, sets, settle(components(links(sets, texts, scheme, proposed)), "roots"))


def near_duplicates(docs: DataFrame, scheme: Scheme = SCHEMES["op11"], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (the smallest key that can be reached), kept (whether it is the row's own)."""
    found = copies(docs, scheme, key, text)
    rooted = found.sets.where("n > 0").select("node", F.col("place.k").alias("k")).join(found.roots, "node", "left")
    rooted = settle(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("k").alias("component_id")), "root").select("node", "component_id")
    filled, empty = (found.rows.where(x) for x in ("n > 0", "n = 0"))
    out = filled.join(named, "node").select("k", "n", "component_id").union(empty.select("k", "n", F.col("k").alias("component_id")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
