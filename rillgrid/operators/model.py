"""Complaint model: folds, class weights, boosted trees, baseline and importances (MLlib)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgrid.operators.validate import pr_auc, roc_auc, roc_auc_of
from rillgrid.skew import salted_join
from rillgrid.staging import release, settle

SEED = 42


def label_cells(grid: DataFrame, complaints: DataFrame, types: Sequence[str], ts: str, since, key: Sequence[str] = ("i", "j")) -> DataFrame:
    """1 for cells with at least one complaint of the given types since a date."""
    hit = complaints.where(F.col("type").isin(list(types)) & (F.col(ts) >= F.lit(since))).select(*key).distinct()
    return grid.join(hit.withColumn("label", F.lit(1)), list(key), "left").fillna(0, ["label"])


def split_by_type(complaints: DataFrame, flood: Sequence[str], backflow: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Flood complaints validate the first layer and backflow complaints label the second; never both."""
    if set(flood) & set(backflow):
        raise ValueError("a complaint type may serve one purpose only")
    return complaints.where(F.col("type").isin(list(flood))), complaints.where(F.col("type").isin(list(backflow)))


def holdout_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` from a hash of key and seed: the same rows whatever the partitioning."""
    h = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", h % 10_000 < F.lit(int(test_size * 10_000)))


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``(group, size, fold)``: groups dealt to folds by falling size, then id, in serpentine order.

    Groups have numeric ids; both orders are range-wise, so many groups of one size are no hot spot.
    """
    from rillgrid.operators.ordering import cumulate

    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    numbered = cumulate(sizes, "size", descending=True).select("size", "n_before")
    within = cumulate(sizes, group, by=["size"]).select("size", group, F.col("n_before").alias("_in"))
    r = salted_join(within, numbered, ["size"], [group]).withColumn("_r", F.col("n_before") + F.col("_in"))
    turn, place = F.floor(F.col("_r") / folds) % 2, F.col("_r") % folds
    fold = F.when(turn == 0, place).otherwise(F.lit(folds - 1) - place)
    return r.select(group, "size", fold.cast("int").alias("fold"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.try_divide(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 1).otherwise(0))).alias("positive_weight")
    )


def _weighted(df: DataFrame, label: str) -> DataFrame:
    w = class_balance(df, label).scalar()
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.coalesce(w, F.lit(1.0))).otherwise(1.0))


def available(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if f in df.columns]


def boosted_trees(features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 5, rate: float = 0.1,
                  subsample: float = 1.0, validation: str | None = None) -> Pipeline:
    gbt = GBTClassifier(
        featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=rate,
        subsamplingRate=subsample, seed=SEED, checkpointInterval=10,
        **({"validationIndicatorCol": validation} if validation else {}),
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), gbt])


def baseline_logistic(features: Sequence[str], label: str = "label") -> Pipeline:
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=0.01, maxIter=50)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), lr])


def fit_weighted(pipeline: Pipeline, train: DataFrame, label: str = "label"):
    return pipeline.fit(_weighted(train, label))


def predict(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(df.withColumn("_weight", F.lit(1.0)))
    return scored.select(*keep, vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("predicted"))


def out_of_fold(df: DataFrame, folds: DataFrame, group: str, key: str, pipeline: Pipeline, n_folds: int = 5,
                label: str = "label") -> DataFrame:
    """Probability of each row from the model that never saw its group: ``(key, fold, label, p, predicted)``."""
    data = settle(df.join(folds.select(group, "fold"), group), "folds")

    def one(k: int) -> DataFrame | None:
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        if test.isEmpty() or train.select(label).distinct().limit(2).count() < 2:
            return None
        return predict(fit_weighted(pipeline.copy(), train, label), test, [key, "fold", label])

    # the folds are independent, so their jobs share the cluster as in MLlib's own tuning
    with ThreadPool(n_folds) as pool:
        parts = [p for p in pool.map(inheritable_thread_target(df.sparkSession)(one), range(n_folds)) if p is not None]
    if not parts:
        raise ValueError("no fold leaves both classes to learn from")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def f1_scores(oof: DataFrame, label: str = "label") -> DataFrame:
    """Mean and deviation over the folds of the F1 score."""
    hit = lambda a, b: F.sum(F.when((F.col("predicted") == a) & (F.col(label) == b), 1).otherwise(0))
    per = oof.groupBy("fold").agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("folds"), F.avg(f1).alias("f1_mean"), F.stddev_pop(f1).alias("f1_std"))


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy("importance")


def permutation_importance(model, df: DataFrame, features: Sequence[str], key: str, label: str = "label") -> DataFrame:
    """Loss of AUC when one feature is dealt to other rows; any fitted model will do.

    Rows are numbered inside hash buckets in two independent orders, and a row takes the value of the row whose second number
    is its first.  One equality join brings a row all values that it may take; it is then repeated once as it is and once per
    feature with that feature changed, and all copies are scored in one pass and ranked side by side.
    """
    spark, features = df.sparkSession, list(features)
    buckets = max(8, math.ceil(df.count() / 20_000))  # a bucket stays small whatever the table
    order = lambda salt: F.row_number().over(
        Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(salt), F.col(key)), F.col(key))
    )
    base = settle(
        df.where(F.col(label).isNotNull()).select(key, label, *[F.col(f).cast("double").alias(f) for f in features])
        .withColumn("_b", F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(buckets)))
        .withColumns({"_to": order(1), "_from": order(2)}),
        "permute",
    )
    donors = base.select("_b", F.col("_from").alias("_to"), F.struct(*features).alias("_moved"))
    copies = F.explode(F.array(*[F.lit(k) for k in range(len(features) + 1)]))
    mixed = base.join(donors, ["_b", "_to"]).withColumn("_copy", copies).select(
        key, label, "_copy", *[F.when(F.col("_copy") == k, F.col("_moved")[f]).otherwise(F.col(f)).alias(f) for k, f in enumerate(features, 1)]
    )
    scored = settle(predict(model, mixed, ["_copy", label]), "copies")
    # each copy of the table is cut at its own quantiles, so none outgrows a task
    auc = {r["_copy"]: r["auc"] for r in roc_auc_of(scored, label, "p", "_copy", range(len(features) + 1)).collect()}
    release(spark, base, scored)
    lost = [None if auc.get(k) is None or auc.get(0) is None else auc[0] - auc[k] for k in range(1, len(features) + 1)]
    rows = [(f, math.nan if x is None else float(x)) for f, x in zip(features, lost)]
    return spark.createDataFrame(rows, "feature string, auc_drop double").orderBy(F.desc("auc_drop"), "feature")


def scores_of(oof: DataFrame, label: str = "label") -> DataFrame:
    one = pr_auc(oof, label, "p").first()
    auc = roc_auc(oof, label, "p")
    return auc.withColumns({"average_precision": F.lit(one["average_precision"]), "positive_rate": F.lit(one["positive_rate"])})
