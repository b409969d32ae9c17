"""Mixing sources to target weights by pivotal dependent rounding.

Sources get shares of all words by weight; a source stops at ``most`` times its own size and the
excess is shared again by weight among the others.  A document of a source is taken target / size
times: a whole number of copies and a fraction.  The fractions are rounded dependently: of two
documents one gives words to the other until one of them has a whole number of copies, the direction
drawn so that neither gains on average.  The words taken from the pair stay the same, so those of a
source differ from its target by less than one document.

The pairing runs as a reduction tree: blocks of about ``BLOCK`` documents of one source are folded
into at most one undecided document each, these into blocks again, until a source has one left, which
is rounded to the nearer number of copies.  A source that holds a third of all rows has a third of the blocks.
Draws come from hashes of the rows, so every run gives the same mix.

Edge cases: a null or empty text has size 0 and is never taken.  A null source is a source of its
own, after all others.  A source of size 0 has target 0.  Rows alike in all columns are rounded as
separate documents but share their hash; ties are broken by their order in the block, and they are
interchangeable.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.llm.common import hinted, let, unit, words_of
from rillgrid.staging import settle

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, the number of the source by code point from 0, null last."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = settle(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # one row per range
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", base + inside - 1).drop("part")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) for ``sources`` (source, source_size, n)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = settle(_ranked(sources).withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))}), "targets")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate, full = None, -1
    while True:  # what sources beyond their cap leave over goes to the others; the set of full sources only grows
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > F.col("cap")
        r = ranked.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if r["full"] == full or not r["open"]:
            break
        full, rate = r["full"], (total - (r["caps"] or 0.0)) / r["open"]
    target = F.least(F.col("weight") * F.lit(rate or 0.0), F.col("cap"))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def _fold(level: int, kind: str) -> Column:
    """Round the documents of ``items`` pairwise; the result's ``done`` are decided, ``left`` is at most one."""

    def step(state: Column, x: Column) -> Column:
        c = state["left"]

        def meet(u: Column) -> Column:
            give = F.least(c["size"] * c["x"], x["size"] * (1 - x["x"]))  # words from the one carried to the new one
            take = F.least(x["size"] * x["x"], c["size"] * (1 - c["x"]))
            gives = u * (give + take) < take
            emptied = give >= c["size"] * c["x"]
            filled = give >= x["size"] * (1 - x["x"])
            c_x = F.when(gives, F.when(emptied, 0.0).otherwise(c["x"] - give / c["size"])).otherwise(
                F.when(take >= c["size"] * (1 - c["x"]), 1.0).otherwise(c["x"] + take / c["size"])
            )
            x_x = F.when(gives, F.when(filled, 1.0).otherwise(x["x"] + give / x["size"])).otherwise(
                F.when(take >= x["size"] * x["x"], 0.0).otherwise(x["x"] - take / x["size"])
            )
            return let(F.struct(c_x.alias("c"), x_x.alias("x")), settled)

        def settled(v: Column) -> Column:
            c_new, x_new = c.withField("x", v["c"]), x.withField("x", v["x"])
            whole = lambda y: (y <= 0) | (y >= 1)
            done = F.when(whole(v["c"]) & whole(v["x"]), F.array(c_new, x_new)).when(whole(v["c"]), F.array(c_new)).otherwise(F.array(x_new))
            left = F.when(~whole(v["x"]), x_new).when(~whole(v["c"]), c_new)
            return F.struct(F.concat(state["done"], done).alias("done"), left.alias("left"))

        draw = unit(c["h"], c["id"], x["h"], x["id"], F.lit(level))
        first = F.struct(state["done"].alias("done"), x.alias("left"))
        return F.when(c.isNull(), first).otherwise(let(draw, meet))

    item = f"struct<o:bigint,h:bigint,id:{kind},size:bigint,x:double>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("left"))
    return F.aggregate("items", start, step)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(h, id, source, size) per row of ``docs``; h is a hash of the whole row."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("h"), F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("size"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """A row per row of ``docs``: h, id, source, size, source_size, target, copies."""
    rows = settle(sized(docs, key, text, source), "sizes")
    kind = rows.schema["id"].dataType.simpleString()
    per_source = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "per_source")
    aims = settle(targets(per_source, weights, most), "aims").withColumnRenamed("source", "s")
    met = rows.join(hinted(aims, aims.count()), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    group = ["source", "source_size", "target", "whole"]
    met = met.withColumn("whole", F.floor(rate).cast("long")).withColumn("x", rate - F.floor(rate))
    is_open = (F.col("size") > 0) & (F.col("x") > 0)
    fixed = met.where(~is_open).select("h", "id", "size", *group, F.lit(0).cast("long").alias("up"))
    rest = met.where(is_open).select("h", "id", "size", "x", *group, F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    decided, level = [fixed], 0
    while rest.take(1):
        dealt = rest.groupBy(*group, "blocks", F.pmod(F.xxhash64("h", "id", F.lit(level)), F.col("blocks")).alias("block"))
        # about ``block`` rows, the longest first: what stays undecided at the end is then a short document
        items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "h", "id", "size", "x")))
        folded = settle(dealt.agg(items.alias("items")).select(*group, "blocks", _fold(level, kind).alias("r")), "folded")
        done = folded.select(*group, F.explode("r.done").alias("d"))
        decided.append(done.select("d.h", "d.id", "d.size", *group, F.col("d.x").cast("long").alias("up")))
        left = folded.where("r.left IS NOT NULL").select("r.left.h", "r.left.id", "r.left.size", "r.left.x", *group, "blocks")
        last = F.when(F.col("x") >= 0.5, 1).otherwise(0).cast("long")
        decided.append(left.where("blocks = 1").select("h", "id", "size", *group, last.alias("up")))
        rest = left.where("blocks > 1").withColumn("blocks", F.ceil(F.col("blocks") / block).cast("long"))
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out.select("h", "id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0).alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    taken = settle(copies(docs, key, text, source, weights, most).select(F.col("h").alias("_h"), F.col("id").alias("_id"), F.col("copies").alias("_n")), "copies")
    per_row = taken.groupBy("_h", "_id").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows")).where("_n > 0")
    whole = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*whole).alias("own"), F.xxhash64(*whole).alias("_row"), F.col(f"`{key}`").alias("_key"))
    met = named.join(per_row, (F.col("_row") == F.col("_h")) & F.col("_key").eqNullSafe(F.col("_id")))
    if taken.groupBy("_h", "_id").count().where("count > 1").take(1):  # rows alike in all columns share their copies
        met = met.where("_rows = 1").union(met.where("_rows > 1").dropDuplicates(["_h", "_id"]))
    return met.select("own", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("own.*")
