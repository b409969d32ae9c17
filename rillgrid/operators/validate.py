"""Validation metrics, agreement, sampling and sensitivity scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.operators.aggregates import coarsen, crosstab
from rillgrid.operators.index import cdri_geometric, weighted_sum
from rillgrid.operators.normalise import max_norm, minmax
from rillgrid.operators.ordering import cumulate, quantiles, with_ranks
from rillgrid.operators.topk import top_n
from rillgrid.skew import HEAVY_ROWS, heavy_keys, salted_join
from rillgrid.staging import settle


def _labels(label: str) -> dict:
    y = F.col(label).cast("int")
    return {"pos": F.when(y == 1, 1).otherwise(0), "neg": F.when(y == 1, 0).otherwise(1)}


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties as one half.

    Works on counts per distinct score: no row is ranked and no pair is formed.
    """
    c = cumulate(df.where(F.col(label).isNotNull()), score, _labels(label))
    return c.agg(_auc(), F.max("pos_all").alias("positives"), F.max("n_all").alias("n"))


def _auc():
    good = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    return F.try_divide(F.sum(good), F.max(F.col("pos_all").cast("double") * F.col("neg_all"))).alias("auc")


def roc_auc_of(df: DataFrame, label: str, score: str, part: str, parts: Sequence) -> DataFrame:
    """``(part, auc)`` for each of a few ``parts`` of a table, all in one pass; a part with one class only has none."""
    named = df.where(F.col(label).isNotNull()).withColumn(part, F.col(part).cast("string"))
    c = cumulate(named, score, _labels(label), by=[part], variables=[str(p) for p in parts])
    return c.groupBy(part).agg(_auc()).select(F.col(part).cast(df.schema[part].dataType).alias(part), "auc")


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: sum over falling scores of recall gained times precision."""
    c = cumulate(df.where(F.col(label).isNotNull()), score, _labels(label), descending=True)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return c.agg(
        F.sum(F.try_divide(F.col("pos"), F.col("pos_all")) * precision).alias("average_precision"),
        F.max(F.try_divide(F.col("pos_all"), F.col("n_all"))).alias("positive_rate"),
    )


def brier(df: DataFrame, label: str, probability: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(probability) - F.col(label), 2)).alias("brier"))


def lift(df: DataFrame, flagged: str, case: str) -> DataFrame:
    """Share flagged in case districts over the share flagged anywhere."""
    f = F.col(flagged).cast("double")
    one = df.agg(F.avg(F.when(F.col(case), f)).alias("case_share"), F.avg(f).alias("all_share"))
    return one.withColumn("lift", F.try_divide("case_share", "all_share"))


def capture_at(df: DataFrame, score: str, key: str, hit: str, share: float = 0.2) -> DataFrame:
    """Share of the known cases that lie in the best-scored ``share`` of cells."""
    from rillgrid.operators.topk import top_share

    marked = top_share(df, score, key, share)
    return marked.where(F.col(hit) == 1).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("in_top").cast("double")).alias("captured")
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties.

    Rows are reduced to distinct value pairs before the ranks are looked up.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    pairs = settle(pairs, "pairs")
    n_pairs, both = pairs.count(), pairs
    for c in ("_a", "_b"):
        pos = cumulate(pairs, c, {"w": F.col("_w")}).select(c, (F.col("w_before") + (F.col("w") + 1) / 2).alias(f"{c}_r"))
        heavy = heavy_keys(pairs, [c]) if n_pairs >= HEAVY_ROWS else None
        both = salted_join(both, pos, [c], ["_a", "_b"], rows=0, heavy=heavy)
    w, x, y = F.col("_w"), F.col("_a_r"), F.col("_b_r")
    s = both.agg(
        F.sum(w).cast("double").alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"),
        F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"),
    )
    n = F.col("n")
    top = n * F.col("xy") - F.col("x") * F.col("y")
    bottom = F.sqrt(n * F.col("xx") - F.col("x") * F.col("x")) * F.sqrt(n * F.col("yy") - F.col("y") * F.col("y"))
    return s.select(n.cast("long").alias("n"), F.try_divide(top, bottom).alias("rho"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's agreement of two labelings, from their crosstab."""
    t = crosstab(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    sides = t.select(F.explode(F.array(
        F.struct(F.col("a").cast("string").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"),
                 F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same")),
        F.struct(F.col("b").cast("string").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), F.lit(0).cast("long").alias("same")),
    )).alias("x")).select("x.*")
    per = sides.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    one = per.agg(
        F.sum("na").cast("double").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross")
    )
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return one.select(F.col("n").cast("long").alias("n"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("accuracy"))


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int) -> DataFrame:
    """The ``per_stratum`` rows of each class with the smallest hash of their key; repeatable."""
    order = Window.partitionBy(stratum).orderBy(F.sha1(F.col(key).cast("string").cast("binary")), F.col(key))
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_stratum)


def median_percentile(df: DataFrame, score: str, key: str, zone: DataFrame) -> DataFrame:
    """Median percentile (0..100) of the zone's cells among all cells."""
    ranked = with_ranks(df.where(F.col(score).isNotNull()), score, [key])
    inside = ranked.join(zone.select(key).distinct(), key, "left_semi").withColumn("pct", F.col("pct_rank") * 100)
    return quantiles(inside, ["pct"], [0.5]).select(F.col("q").alias("median_percentile"))


def temporal_split_auc(df: DataFrame, year: str, first_test_year: int, group: str, label: str) -> DataFrame:
    """Rate per group learnt on earlier years, judged by AUC on later years."""
    rate = df.where(F.col(year) < first_test_year).groupBy(group).agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    later = df.where(F.col(year) >= first_test_year).join(rate, group, "left").withColumn(
        "_p", F.round(F.coalesce("_rate", F.lit(0.0)), 9)
    )
    return roc_auc(later, label, "_p")


def zone_overlap(forecast: DataFrame, observed: DataFrame, keys: Sequence[str] = ("i", "j")) -> DataFrame:
    """Shared cells and intersection over union of two cell sets."""
    keys = list(keys)
    f = forecast.select(*keys).distinct().withColumn("f", F.lit(1))
    o = observed.select(*keys).distinct().withColumn("o", F.lit(1))
    both = F.col("f").isNotNull() & F.col("o").isNotNull()
    return f.join(o, keys, "full").agg(
        F.count(F.lit(1)).alias("union_cells"),
        F.count(F.when(both, 1)).alias("shared_cells"),
        F.avg(both.cast("double")).alias("iou"),
    )


# -- sensitivity -------------------------------------------------------------------------------

# Reference weight sets, the first is the base.
WEIGHT_SETS = (
    ("기본", 0.4, 0.35, 0.25),
    ("침수 강조", 0.5, 0.3, 0.2),
    ("역류 강조", 0.3, 0.5, 0.2),
    ("취약계층 강조", 0.3, 0.3, 0.4),
    ("균등", 0.33, 0.34, 0.33),
)


def weight_sensitivity(cells: DataFrame, parts: Sequence[str], key: str, sets=WEIGHT_SETS, n: int = 20) -> DataFrame:
    """``(label, overlap_pct)`` of the top list of each weight set with that of the first.

    Every cell is listed once per weight set; ``row_number() <= n`` keeps n rows per task before
    the shuffle.
    """
    rows = F.array(*[
        F.struct(F.lit(label).alias("label"), F.round(weighted_sum(dict(zip(parts, w))), 9).alias("s")) for label, *w in sets
    ])
    long = cells.select(F.col(key), F.explode(rows).alias("r")).select(key, "r.label", "r.s")
    order = Window.partitionBy("label").orderBy(F.desc("s"), key)
    top = long.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("label", key)
    # at most n rows per weight set from here on
    base = F.max(F.when(F.col("label") == sets[0][0], 1).otherwise(0)).over(Window.partitionBy(key))
    return top.withColumn("_base", base).groupBy("label").agg((F.sum("_base") / F.lit(n) * 100).alias("overlap_pct"))


def index_weight_sets(cells: DataFrame, key: str, sets: Mapping[str, Sequence[float]], n: int = 20) -> DataFrame:
    """The product index of ``h, e, v`` under several weight sets against the first: ``(label, cells, rho, shared)``.

    ``rho`` is the rank correlation over all ranked cells, ``shared`` how many of the top ``n`` stay.
    """
    base, *others = sets
    scored = cells
    for label in sets:
        one = cdri_geometric(cells, sets[label]).select(F.col(key), F.round("cdri", 9).alias(f"s_{label}"))
        scored = one if label == base else scored.join(one, key)
    scored = settle(scored, "weight-sets")
    first = top_n(scored, f"s_{base}", key, n).select(key)
    out = None
    for label in others:
        shared = first.intersect(top_n(scored, f"s_{label}", key, n).select(key)).agg(F.count(F.lit(1)).alias("shared"))
        rho = spearman(scored, f"s_{base}", f"s_{label}").select(F.lit(label).alias("label"), F.col("n").alias("cells"), "rho")
        row = rho.join(shared.withColumn("label", F.lit(label)), "label")
        out = row if out is None else out.unionByName(row)
    return out


def rank_scenarios(cells: DataFrame, parts: Sequence[str], key: str, sets=WEIGHT_SETS[:3]) -> DataFrame:
    """Rank of each cell under weights x two scalings x two ways to combine: median and range."""
    parts = list(parts)
    lo = minmax(cells.select(key, *parts), {p: f"a_{p}" for p in parts})
    both = max_norm(lo, {p: f"b_{p}" for p in parts}).drop(*parts)
    both = settle(both, "scaled")  # a dozen scores read each scaled value
    rows = []
    for label, *w in sets:
        for norm in ("a", "b"):
            names = [f"{norm}_{p}" for p in parts]
            product = F.lit(1.0)
            for name, x in zip(names, w):
                product = product * F.pow(F.greatest(F.col(name), F.lit(0.0)) + F.lit(0.05), F.lit(float(x)))
            rows.append((f"{label}|{norm}|sum", F.round(weighted_sum(dict(zip(names, w))), 9)))
            rows.append((f"{label}|{norm}|product", F.round(product, 9)))
    long = both.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), s.alias("s")) for n, s in rows])).alias("r"))
    long = long.select(key, "r.scenario", "r.s")
    ranked = with_ranks(long, "s", [key], by=["scenario"], descending=True)
    # a cell has one rank per scenario, so this percentile holds a dozen values
    return ranked.groupBy(key).agg(
        F.percentile("rank", 0.5).alias("median_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank")
    )


def unit_effect(cells: DataFrame, score: str, district: str, factor: int = 5, n: int = 20) -> DataFrame:
    """Do district means keep their order when cells are merged into blocks?  ``(n, rho)``.

    A block belongs to the district of its first cell.
    """
    fine = cells.groupBy(district).agg(F.round(F.avg(score), 9).alias("fine"))
    blocks = coarsen(cells, score, factor)
    home = cells.groupBy(F.floor(F.col("i") / factor).alias("bi"), F.floor(F.col("j") / factor).alias("bj")).agg(
        F.min_by(district, F.struct("i", "j")).alias(district)
    )
    coarse = blocks.join(home, ["bi", "bj"]).groupBy(district).agg(F.round(F.avg("max_score"), 9).alias("coarse"))
    return spearman(fine.join(coarse, district), "fine", "coarse")


def grade_shift(cells: DataFrame, before: str, after: str) -> DataFrame:
    return crosstab(cells, before, after)


def drop_variable(cells: DataFrame, score_with: str, score_without: str) -> DataFrame:
    return spearman(cells, score_with, score_without)


def overlap_rate(top: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Share of the top list that lies in designated zones."""
    hit = top.join(zones.select(key).distinct().withColumn("_z", F.lit(1)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("listed"), F.count("_z").alias("designated"), (F.count("_z") / F.count(F.lit(1))).alias("overlap_rate"))
