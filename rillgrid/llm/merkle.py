"""A Merkle manifest of a dataset: per-group trees of document hashes under one root, with a proof for every document.

A document's leaf is the SHA-256 of its fields, each with its length.  The leaves of a group (``lang``) ascend by key and are
reduced in runs of ``FAN`` until one node, the subroot, is left; the subroots, ordered by group, are reduced likewise to the root.

Positions come without sorting.  The keys of a group are merged into bitmaps of 64-bit words, of which only words that hold a
key exist; a directory holds the number of rows before each word.  It is a radix tree over the word numbers: sums of 4,096
children each, so no window ever sees more rows, however sparse the keys are or however large a group is.  A document's
position is the directory's number plus the set bits below its own.  Leaves are then gathered by position into slot arrays
of ``FAN ** 3``, three levels of the tree are reduced inside a row, and their tops are the slots of the next array; a tree over n
leaves takes log512(n) shuffles.  Proofs go the other way: an array's path to the root is joined to it once, and its slots
add their own three levels, so no proof is shuffled with a document.

Edge cases: a null field counts as ``-``, an empty text is a text of length 0, and texts are hashed whole.  A null group is a group of its
own, before all others.  A null key counts as the least long.  Rows of one key are ordered by leaf; rows alike in all fields
have equal leaves at consecutive positions.  Columns besides the named ones are ignored.  An empty table has no root and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.llm.common import hinted, let
from rillgrid.staging import settle

FAN = 8
STEPS = 3  # levels reduced inside a row
SPAN = FAN**STEPS
RADIX = 12  # bits of a directory level
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEAST = -(1 << 63)


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields as hex: of each ``-`` if null, else the length of its UTF-8 bytes, a colon and its value."""
    whole = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*whole), 256)


def offsets(counts: DataFrame, group: Sequence[str], low: int, high: int) -> DataFrame:
    """(group, at, base) of ``counts`` (group, at, n) with one row for each ``at`` from ``low`` to ``high``: the sum of ``n`` over the smaller ones."""
    last = high - low < 1 << RADIX
    up = counts.withColumn("up", F.lit(0).cast("long") if last else F.shiftright("at", RADIX))
    before = Window.partitionBy(*group, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inner = up.select(*group, "at", "up", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if last:
        return inner.drop("up")
    sums = up.groupBy(*group, F.col("up").alias("at")).agg(F.sum("n").alias("n"))
    above = offsets(sums, group, low >> RADIX, high >> RADIX).select(*group, F.col("at").alias("up"), F.col("base").alias("more"))
    return inner.join(above, [*group, "up"]).select(*group, "at", (F.col("base") + F.col("more")).alias("base"))


def positions(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, k, leaf, n, ...), one row per distinct leaf that stands ``n`` times, with ``pos``: how many rows of ``g`` come before its first."""
    placed = leaves.withColumns({"word": F.shiftright("k", 6), "bit": F.col("k").bitwiseAND(F.lit(63)).cast("int")})
    one = F.expr("shiftleft(1L, bit)")
    words = settle(placed.groupBy("g", "word").agg(F.bit_or(one).alias("bits"), F.sum("n").alias("n")), "words")
    low, high = words.agg(F.min("word"), F.max("word")).first()
    if low is None:
        return leaves.withColumn("pos", F.lit(0).cast("long"))
    base = offsets(words.select("g", F.col("word").alias("at"), "n"), ["g"], low, high).withColumnRenamed("at", "word")
    # keys that stand more than once: at most 64 of them share a word
    many = settle(leaves.groupBy("g", "k").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("c")).where("w > 1"), "many")
    repeated = many.groupBy("g", F.shiftright("k", 6).alias("word")).agg(F.collect_list(F.struct(F.col("k").bitwiseAND(F.lit(63)).cast("int").alias("bit"), (F.col("w") - 1).alias("w"))).alias("more"))
    directory = settle(words.drop("n").join(base, ["g", "word"]).join(repeated, ["g", "word"], "left"), "directory")
    found = placed.join(directory, ["g", "word"])
    own, more = F.col("bit"), F.coalesce("more", F.expr("array()"))
    extra = F.aggregate(more, F.lit(0).cast("long"), lambda s, m: s + F.when(m["bit"] < own, m["w"]).otherwise(0))
    pos = F.col("base") + F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))) + extra
    found = found.withColumn("pos", pos.cast("long")).select(*leaves.columns, "pos")
    several = many.where("c > 1").select("g", "k")
    if not several.take(1):
        return found
    # different leaves of one key: the same directory over the first 60 bits of the leaf, then the leaf itself
    tied = leaves.join(several, ["g", "k"], "left_semi").select("g", "k", "leaf", "n", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long").alias("at"))
    inside = offsets(tied.groupBy("g", "k", "at").agg(F.sum("n").alias("n")), ["g", "k"], 0, (1 << 60) - 1)
    alike = Window.partitionBy("g", "k", "at").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    within = tied.withColumn("same", F.coalesce(F.sum("n").over(alike), F.lit(0))).join(inside, ["g", "k", "at"])
    within = within.select("g", "k", "leaf", (F.col("base") + F.col("same")).alias("inside"))
    return found.join(within, ["g", "k", "leaf"], "left").withColumn("pos", F.col("pos") + F.coalesce("inside", F.lit(0))).drop("inside")


def _repeated(rows: DataFrame) -> DataFrame:
    """A row per position for leaves that stand several times; long runs are listed in pieces."""
    piece = 1 << 16
    starts = rows.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {piece}L)")))
    every = starts.withColumn("nth", F.explode(F.expr(f"sequence(from, least(from + {piece - 1}L, n - 1))")))
    return every.withColumn("pos", F.col("pos") + F.col("nth")).drop("from", "nth", "n")


def _above(nodes: Column) -> Column:
    """Hashes of the runs of ``nodes``."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def _arrays(nodes: DataFrame, totals: DataFrame, groups: int) -> DataFrame:
    """Slot arrays (g, block, keys, a, b, c, top, steps) of ``nodes`` (g, pos, hash, and what else a slot carries) under ``totals`` (g, total)."""
    carried = [c for c in nodes.columns if c not in ("g", "pos", "hash")]
    slot = F.struct(F.pmod("pos", F.lit(SPAN)).cast("int").alias("slot"), "hash", *carried)
    gathered = nodes.groupBy("g", F.floor(F.col("pos") / SPAN).cast("long").alias("block")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    gathered = settle(gathered.select("g", "block", F.col("slots.hash").alias("a"), *[F.col(f"slots.{c}").alias(c) for c in carried]), "slots")
    levels = let(_above(F.col("a")), lambda b: let(_above(b), lambda c: F.struct(b.alias("b"), c.alias("c"), _above(c).alias("d"))))
    steps = reduce(lambda out, s: F.when(F.col("total") <= FAN**s, s).otherwise(out), range(STEPS - 1, -1, -1), F.lit(STEPS))
    whole = gathered.join(hinted(totals, groups), "g").withColumn("up", levels).withColumn("steps", steps)
    tops = F.array(F.col("a")[0], F.col("up.b")[0], F.col("up.c")[0], F.col("up.d")[0])
    return settle(whole.select("g", "block", *carried, "a", "up.b", "up.c", F.get(tops, F.col("steps")).alias("top"), "steps", "total"), "nodes")


def _own(i: Column) -> Column:
    """(before, after) of slot ``i`` on each level of its array: the hashes of its run on either side."""
    out = []
    for level, name in enumerate("abc"):
        at = F.floor(i / FAN**level).cast("int")
        place = F.pmod(at, F.lit(FAN))
        out.append(F.struct(
            F.array_join(F.slice(F.col(name), at - place + 1, place), "").alias("before"), F.array_join(F.slice(F.col(name), at + 2, FAN - 1 - place), "").alias("after"),
        ))
    return F.slice(F.array(*out), F.lit(1), F.col("steps"))


def _slots(arrays: DataFrame, above: DataFrame | None, what) -> DataFrame:
    """``what(i, path)`` for each slot ``i`` of ``arrays``; ``above`` (g, block, path) leads on from the arrays' tops."""
    whole = arrays.withColumn("path", F.expr("CAST(array() AS ARRAY<STRUCT<before: STRING, after: STRING>>)")) if above is None else arrays.join(above, ["g", "block"])
    every = F.sequence(F.lit(0), F.size("a") - 1)
    made = F.transform(every, lambda i: let(F.concat(_own(i), F.col("path")), lambda path: what(i, path)))
    return whole.select("g", "block", F.explode(made).alias("x")).select("g", "block", "x.*")


def _levels(nodes: DataFrame, totals: DataFrame, groups: int, largest: int) -> list[DataFrame]:
    """The slot arrays of all levels, lowest first."""
    out = [_arrays(nodes, totals, groups)]
    while largest > SPAN:
        largest = -(-largest // SPAN)
        below = out[-1].where(F.col("total") > SPAN)
        totals = totals.where(F.col("total") > SPAN).withColumn("total", F.ceil(F.col("total") / SPAN))
        out.append(_arrays(below.select("g", F.col("block").alias("pos"), F.col("top").alias("hash")), totals, groups))
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [x.where(F.col("total") <= SPAN).select("g", "top") for x in levels])


def _paths(levels: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """(g, block, path) of the lowest arrays of ``levels``; ``above`` (g, path) leads on from the tops of the groups."""
    known = None
    for number in range(len(levels) - 1, 0, -1):
        nodes = _slots(levels[number], _joined(levels[number], known, above), lambda i, path: F.struct(i.alias("i"), path.alias("path")))
        known = settle(nodes.select("g", (F.col("block") * SPAN + F.col("i")).alias("block"), "path"), "paths")
    return _joined(levels[0], known, above)


def _joined(level: DataFrame, known: DataFrame | None, above: DataFrame | None) -> DataFrame | None:
    if above is None:
        return known
    ends = level.where(F.col("total") <= SPAN).select("g", "block").join(above, "g")
    return ends if known is None else ends.unionAll(known)


def _numbered(groups: DataFrame) -> DataFrame:
    """``groups`` (g, ...) with ``pos`` in the order of ``g``: dealt into ranges, numbered inside a range."""
    dealt = settle(groups.repartitionByRange("g").withColumn("part", F.spark_partition_id()), "groups")
    sizes = dict(dealt.groupBy("part").count().collect())  # as many rows as ranges
    starts, n = {}, 0
    for part in sorted(sizes):
        starts[part], n = n, n + sizes[part]
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    inside = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    return dealt.withColumn("pos", start[F.col("part").cast("long")] + inside).drop("part")


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Per row of ``docs``: key, group, leaf, subroot, root, proof_sha256 (of the siblings from the leaf to the root), folded_root, verified.

    ``claimed`` names fields for which another version of the document has other values; ``folded_root`` is what the leaf of
    that version and the siblings of the original lead to, and ``verified`` whether this is the root.  ``key`` is a whole number.
    """
    cols = {c: F.col(f"`{c}`") for c in fields}
    own = digest(list(cols.values()))
    other = digest([(claimed or {}).get(c, x) for c, x in cols.items()])
    g = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), F.col(f"`{group}`").cast("string")))
    hashed = docs.select(g.alias("g"), F.col(f"`{key}`").cast("long").alias("id"), own.alias("leaf"), other.alias("other"))
    hashed = hashed.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other")))  # given by the leaf, as both hash the same fields
    each = hashed.groupBy("g", "id", "leaf", "other").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.coalesce("id", F.lit(_LEAST)))
    each = settle(each, "leaves")
    totals = settle(each.groupBy("g").agg(F.sum("n").alias("total")), "totals")
    groups, largest = totals.agg(F.count(F.lit(1)), F.max("total")).first()
    names = [docs.schema[c].dataType.simpleString() for c in (key, group)]
    if not groups:
        empty = f"`{key}` {names[0]}, `{group}` {names[1]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], empty)
    leaves = _repeated(positions(each)).select("g", "pos", F.col("leaf").alias("hash"), "id", "other")
    trees = _levels(leaves, totals, groups, largest)
    subroots = _numbered(_tops(trees))
    crown = docs.sparkSession.createDataFrame([("", groups)], "g string, total long")
    roots = _levels(subroots.select(F.lit("").alias("g"), "pos", F.col("top").alias("hash"), F.col("g").alias("of")), crown, 1, groups)
    root = _tops(roots).first()["top"]
    ends = _slots(roots[0], _paths(roots, None), lambda i, path: F.struct(F.col("of")[i].alias("of"), F.col("a")[i].alias("subroot"), path.alias("path")))
    ends = settle(ends.select(F.col("of").alias("g"), "subroot", "path"), "subroots")
    above = _paths(trees, hinted(ends.select("g", "path"), groups))

    def proved(i: Column, path: Column) -> Column:
        leaf = F.col("a")[i]
        siblings = F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")
        folded = F.aggregate(path, F.coalesce(F.col("other")[i], leaf), lambda x, p: F.sha2(F.concat(p["before"], x, p["after"]), 256))
        return F.struct(F.col("id")[i].alias("id"), leaf.alias("leaf"), F.sha2(siblings, 256).alias("proof"), folded.alias("folded"))

    out = _slots(trees[0], above, proved).join(hinted(ends.select("g", "subroot"), groups), "g")
    named = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).cast(names[1])
    return out.select(
        F.col("id").cast(names[0]).alias(key), named.alias(group), "leaf", "subroot", F.lit(root).alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"),
    )
