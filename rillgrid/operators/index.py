"""Layer scores, the composite index in both generations, weights and contributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgrid.functions.scores import GRADE_MATRIX, class_code, grade_fixed, grade_index, matrix_grade
from rillgrid.operators.cleaning import fill_median, fill_zero
from rillgrid.operators.normalise import jenks_breaks, minmax, rescale, winsorize, zscore
from rillgrid.operators.ordering import moments, with_ranks
from rillgrid.staging import settle

# -- first generation: min-max and weighted sums ------------------------------------------------


# Weight, direction (-1 where little is risky) and fill of each column of the first layers.
LAYERS: dict[str, dict[str, tuple[float, int, str]]] = {
    "flood_score": {"pump_capacity": (0.4, -1, "zero"), "mean_rain": (0.35, 1, "zero"), "mean_elev": (0.25, -1, "median")},
    "sewer_score": {"old_pipe_ratio": (0.4, 1, "zero"), "mean_diameter": (0.3, -1, "median"), "complaints": (0.3, 1, "zero")},
    "vuln_score": {"elderly_ratio": (0.4, 1, "zero"), "single_ratio": (0.3, 1, "zero"), "old_building_ratio": (0.3, 1, "zero")},
}
# The sewer layer of tables without complaints.
SEWER_WITHOUT_COMPLAINTS = {"old_pipe_ratio": (0.55, 1, "zero"), "mean_diameter": (0.45, -1, "median")}


def weighted_sum(weights: Mapping[str, float]) -> F.Column:
    out = F.lit(0.0)
    for column, w in weights.items():
        out = out + F.lit(float(w)) * F.col(column)
    return out


def layer_scores(grid: DataFrame, layers: Sequence[str] = tuple(LAYERS)) -> DataFrame:
    """The named layers of ``LAYERS`` as weighted sums of min-max scaled columns.

    All layers share one pass for the medians and one for the extremes.
    """
    terms = {name: SEWER_WITHOUT_COMPLAINTS if name == "sewer_score" and "complaints" not in grid.columns else LAYERS[name] for name in layers}
    columns = {c: how for group in terms.values() for c, how in group.items()}
    g = fill_zero(grid, [c for c, (_, _, fill) in columns.items() if fill == "zero"])
    medians = [c for c, (_, _, fill) in columns.items() if fill == "median"]
    g = fill_median(g, medians) if medians else g
    g = minmax(g, {c: f"_m_{c}" for c in columns}, invert=[c for c, (_, sign, _) in columns.items() if sign < 0])
    sums = {name: weighted_sum({f"_m_{c}": w for c, (w, _, _) in group.items()}) for name, group in terms.items()}
    return g.withColumns(sums).drop(*[f"_m_{c}" for c in columns])


def flood_score(grid: DataFrame) -> DataFrame:
    return layer_scores(grid, ["flood_score"])


def sewer_score(grid: DataFrame) -> DataFrame:
    return layer_scores(grid, ["sewer_score"])


def vulnerability_score(grid: DataFrame) -> DataFrame:
    return layer_scores(grid, ["vuln_score"])


def integrated_risk(grid: DataFrame, w1: float = 0.4, w2: float = 0.35, w3: float = 0.25) -> DataFrame:
    g = grid.withColumn("risk_score", weighted_sum({"flood_score": w1, "sewer_score": w2, "vuln_score": w3}))
    return g.withColumn("risk_grade", grade_fixed("risk_score"))


# -- second generation: winsorized z-scores and the product of hazard, exposure, vulnerability --


def sums_of_z(df: DataFrame, sums: Mapping[str, Mapping[str, int]], winsor: bool = True) -> DataFrame:
    """Sums of sign-aligned z-scores; ``sums`` maps output names to ``{column: +1 or -1}``.

    All columns of all sums share one pass for the percentiles and one for the moments.  A missing
    value adds nothing.
    """
    signs = {c: k for group in sums.values() for c, k in group.items()}
    work = {c: f"_w_{c}" for c in signs}
    base = df.withColumns({w: F.col(c).cast("double") for c, w in work.items()})
    if winsor:
        base = winsorize(base, list(work.values()))
    base = zscore(base, {w: w for w in work.values()}, {work[c]: k for c, k in signs.items()})
    totals = {}
    for out, group in sums.items():
        total = F.lit(0.0)
        for c in group:
            total = total + F.coalesce(F.col(work[c]), F.lit(0.0))
        totals[out] = total
    return base.withColumns(totals).drop(*work.values())


def layer1(df: DataFrame, exposure: Mapping[str, int], sensitivity: Mapping[str, int], classes: int = 4, grades: bool = True,
           matrix: Sequence[Sequence[int]] = GRADE_MATRIX) -> DataFrame:
    """Climate exposure and urban sensitivity: ``z_exposure, z_sensitivity, l1`` and, with ``grades``,
    the matrix grade ``l1_grade`` of their natural classes (1 = worst)."""
    z = settle(sums_of_z(df, {"z_exposure": exposure, "z_sensitivity": sensitivity}), "layer1")
    scaled = minmax(z.withColumn("_sum", F.col("z_exposure") + F.col("z_sensitivity")), {"_sum": "l1"}).drop("_sum")
    if not grades:
        return scaled
    codes = {}
    for c in ("z_exposure", "z_sensitivity"):
        codes[c] = F.lit(classes + 1) - class_code(c, jenks_breaks(z, c, classes))
    return scaled.withColumn("l1_grade", matrix_grade(codes["z_exposure"], codes["z_sensitivity"], matrix))


def layer2_rules(df: DataFrame, columns: Sequence[str], eps: float = 0.05) -> DataFrame:
    """Geometric mean of the scaled terms (``l2``) beside the additive form (``l2_additive``)."""
    scaled = minmax(df, {c: f"_m_{c}" for c in columns})
    product, total = F.lit(1.0), F.lit(0.0)
    for c in columns:
        product = product * (F.col(f"_m_{c}") + F.lit(eps))
        total = total + F.col(f"_m_{c}")
    raw = scaled.withColumns({"_g": F.pow(product, F.lit(1.0 / len(columns))), "_a": total / len(columns)})
    return minmax(raw, {"_g": "l2", "_a": "l2_additive"}).drop("_g", "_a", *[f"_m_{c}" for c in columns])


def layer3(df: DataFrame, columns: Mapping[str, int], classes: int | None = None) -> DataFrame:
    """Vulnerability ``l3`` and, with ``classes``, its natural class ``l3_grade`` (1 = least vulnerable)."""
    scaled = minmax(sums_of_z(df, {"_z": columns}, winsor=False), {"_z": "l3"}).drop("_z")
    if classes is None:
        return scaled
    scaled = settle(scaled, "layer3")
    return scaled.withColumn("l3_grade", class_code("l3", jenks_breaks(scaled, "l3", classes)))


def hazard(df: DataFrame) -> DataFrame:
    """Mean of both layers; outside the treatment area the first layer stands alone."""
    known = F.col("l2").isNotNull()
    return df.withColumns(
        {"h": F.when(known, 0.5 * F.col("l1") + 0.5 * F.col("l2")).otherwise(F.col("l1")),
         "h_source": F.when(known, "L1+L2").otherwise("L1")}
    )


def exposure(df: DataFrame, people: str, buildings: str) -> DataFrame:
    return minmax(sums_of_z(df, {"_z": {people: 1, buildings: 1}}, winsor=False), {"_z": "e"}).drop("_z")


def universe_flag(people, buildings) -> F.Column:
    return (F.coalesce(F.col(people), F.lit(0)) > 0) | (F.coalesce(F.col(buildings), F.lit(0)) >= 1)


def cdri_geometric(df: DataFrame, weights: Sequence[float] = (1 / 3, 1 / 3, 1 / 3), out: str = "cdri") -> DataFrame:
    """Weighted product of H, E and V over the cells with exposure, scaled to 0..1."""
    g = rescale(df.where(F.col("e") > 0), {"h": "_h", "v": "_v"})
    w = [F.lit(float(x)) for x in weights]
    g = g.withColumn("_p", F.pow("_h", w[0]) * F.pow("e", w[1]) * F.pow("_v", w[2]))
    return minmax(g, {"_p": out}).drop("_h", "_v", "_p")


def cdri_additive(df: DataFrame, weights: Sequence[float] = (1 / 3, 1 / 3, 1 / 3), out: str = "cdri_additive") -> DataFrame:
    return df.withColumn(out, weighted_sum(dict(zip(("h", "e", "v"), weights))))


def with_index_grade(df: DataFrame, score: str = "cdri") -> DataFrame:
    return df.withColumn("grade", grade_index(score))


def contribution(df: DataFrame, parts: Mapping[str, float], key: str) -> DataFrame:
    """Percent of the weighted sum by part, percentile of each part, and the main cause."""
    total = weighted_sum(parts)
    out = df.withColumns({f"pct_{p}": F.try_divide(F.lit(float(w)) * F.col(p), total) * 100 for p, w in parts.items()})
    for p in parts:
        out = with_ranks(out, p, [key], prefix=f"{p}_").drop(f"{p}_rank", f"{p}_rank_avg")
    best = F.greatest(*[F.col(f"{p}_pct_rank") for p in parts])
    cause = None
    for p in parts:
        hit = F.col(f"{p}_pct_rank") == best
        cause = F.when(hit, p) if cause is None else cause.when(hit, p)
    return out.withColumn("main_cause", cause)


def fvi_ratio(exposed, susceptible, resilient) -> F.Column:
    return F.try_divide(F.col(exposed) * F.col(susceptible), F.col(resilient))


# -- weights -----------------------------------------------------------------------------------


def entropy_weights(df: DataFrame, columns: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """``(var, e, w)``.

    With t = x + eps and T = sum(t), the entropy is (ln T - sum(t ln t)/T) / ln n: two sums per
    variable, so one aggregate pass and no share per cell.
    """
    t = {c: F.col(c) + F.lit(eps) for c in columns}
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.sum(t[c]).alias(f"{c}_t"), F.sum(t[c] * F.log(t[c])).alias(f"{c}_l")]
    one = df.dropna(subset=list(columns)).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("var"),
            F.coalesce(F.try_divide(F.log(F.col(f"{c}_t")) - F.try_divide(F.col(f"{c}_l"), F.col(f"{c}_t")), F.log(F.col("n").cast("double"))), F.lit(1.0)).alias("e"),
        )
        for c in columns
    ])
    spread = one.withColumn("rows", rows).withColumn(
        "total", F.aggregate("rows", F.lit(0.0), lambda a, r: a + (1 - r["e"]))
    )
    return spread.select(F.explode("rows").alias("r"), "total").select(
        "r.var", "r.e", F.when(F.col("total") > 1e-12, F.try_divide(1 - F.col("r.e"), F.col("total"))).otherwise(1.0 / len(columns)).alias("w")  # nothing to tell apart: equal weights
    )


# Fixed value: random index of a 3 x 3 pairwise matrix.
RANDOM_INDEX_3 = 0.58


def ahp_weights(answers: DataFrame, items: int = 3, random_index: float = RANDOM_INDEX_3) -> DataFrame:
    """``(item, w, cr)`` from answers ``(respondent, i, j, value)`` with both triangles and the diagonal."""
    pooled = answers.groupBy("i", "j").agg(F.exp(F.avg(F.log("value"))).alias("a"))
    rows = pooled.groupBy("i").agg(F.exp(F.avg(F.log("a"))).alias("g"))
    total = rows.agg(F.sum("g").alias("t")).scalar()
    w = rows.select("i", (F.col("g") / total).alias("w"))
    product = pooled.join(w.select(F.col("i").alias("j"), F.col("w").alias("wj")), "j").groupBy("i").agg(
        F.sum(F.col("a") * F.col("wj")).alias("aw")
    )
    lam = product.join(w, "i").agg(F.avg(F.col("aw") / F.col("w")).alias("l")).scalar()
    cr = (lam - F.lit(float(items))) / F.lit(float(items - 1)) / F.lit(random_index)
    return w.select(F.col("i").alias("item"), "w", cr.alias("cr"))
