"""Complaint model on the cell features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillgrid.operators import model
from rillgrid.operators.spatial import with_cell
from rillgrid.plans import risk
from rillgrid.plans.registry import R, query
from rillgrid.staging import settle

FEATURES = ["old_pipe_ratio", "pipe_length", "pump_capacity", "mean_rain", "old_building_ratio", "elderly_ratio", "single_ratio"]
BACKFLOW = ["error"]
FLOOD = ["purchase", "view"]
SINCE = "2024-01-15 00:00:00"


def labelled_cells(r):
    """Cell features without nulls, with the backflow label."""
    since = F.to_timestamp(F.lit(SINCE)).cast("timestamp_ntz")
    backflow = with_cell(r.complaint.where(F.col("ts") >= since))
    g = model.label_cells(risk.grid_features(r).drop("complaints"), backflow, BACKFLOW, "ts", SINCE)
    watched = F.pmod(F.xxhash64("grid_id"), F.lit(5)) == 0
    return settle(g.fillna(0.0, [c for c in model.available(g, FEATURES)]).withColumn("watched", watched), "labelled")


def _out_of_fold(r, pipeline):
    g = labelled_cells(r)
    folds = model.group_folds(g, "dong", 5)
    return model.out_of_fold(g, folds, "dong", "grid_id", pipeline(model.available(g, FEATURES)))


def _trees(features):
    """Up to 500 shallow trees that stop when a fifth of the training cells, kept apart, gains no more."""
    return model.boosted_trees(features, trees=500, depth=4, rate=0.05, subsample=0.8, validation="watched")


@query("ml1_train_classifier")
def _(r):
    g = labelled_cells(r)
    features = model.available(g, FEATURES)
    train, test = (lambda d: (d.where(~F.col("is_test")), d.where("is_test")))(model.holdout_split(g, "grid_id"))
    fitted = model.fit_weighted(model.boosted_trees(features), train)
    return model.predict(fitted, test, ["grid_id", "label"])


_LABEL = f"SELECT DISTINCT x // 100 AS i, y // 100 AS j FROM complaint WHERE type = 'error' AND ts >= TIMESTAMP '{SINCE}'"


@query(
    "ml2_class_balance",
    f"""WITH l AS ({_LABEL}) SELECT {R('count(*) FILTER (WHERE l.i IS NULL) * 1.0 / count(*) FILTER (WHERE l.i IS NOT NULL)')} AS positive_weight
        FROM grid g LEFT JOIN l ON l.i = g.i AND l.j = g.j""",
)
def _(r):
    return model.class_balance(labelled_cells(r))


@query(
    "ml3_group_folds",
    """WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY size DESC, o_custkey) - 1 AS r FROM s)
       SELECT o_custkey, size, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM n""",
)
def _(r):
    return model.group_folds(r.table("orders").select("o_custkey"), "o_custkey", 5)


@query("ml4_out_of_fold")
def _(r):
    return _out_of_fold(r, _trees)


@query("ml4_out_of_fold_scores")
def _(r):
    return model.scores_of(settle(_out_of_fold(r, _trees), "oof"))


@query("ml5_baseline_logistic")
def _(r):
    return model.scores_of(settle(_out_of_fold(r, model.baseline_logistic), "oof"))


@query("ml6_feature_importance")
def _(r):
    g = labelled_cells(r)
    features = model.available(g, FEATURES)
    return model.feature_importance(model.fit_weighted(_trees(features), g), features, r.spark)


@query("ml7_permutation_importance")
def _(r):
    g = labelled_cells(r)
    features = model.available(g, FEATURES)
    fitted = model.fit_weighted(_trees(features), g)
    return model.permutation_importance(fitted, g, features, "grid_id")


@query(
    "ml8_label_cells",
    f"WITH l AS ({_LABEL}) SELECT grid_id, CAST(CASE WHEN l.i IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS label FROM grid g LEFT JOIN l ON l.i = g.i AND l.j = g.j",
)
def _(r):
    since = F.to_timestamp(F.lit(SINCE)).cast("timestamp_ntz")
    c = with_cell(r.complaint.where(F.col("ts") >= since))
    return model.label_cells(r.grid, c, BACKFLOW, "ts", SINCE).select("grid_id", "label")


@query(
    "ml9_split_by_type",
    """SELECT 'flood' AS use, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type IN ('purchase', 'view')
       UNION ALL SELECT 'backflow', count(*), min(event_id) FROM events WHERE event_type = 'error'""",
)
def _(r):
    flood, backflow = model.split_by_type(r.complaint, FLOOD, BACKFLOW)
    count = lambda d, use: d.agg(F.count(F.lit(1)).alias("n"), F.min("c_id").alias("first_id")).select(F.lit(use).alias("use"), "n", "first_id")
    return count(flood, "flood").unionByName(count(backflow, "backflow"))


@query(
    "ml10_holdout_split",
    "SELECT o_orderkey, CAST(concat('0x', substr(sha1(concat('42:', o_orderkey)), 1, 8)) AS BIGINT) % 10000 < 2000 AS is_test FROM orders",
)
def _(r):
    return model.holdout_split(r.table("orders").select("o_orderkey"), "o_orderkey")


@query("vl11_f1_folds")
def _(r):
    return model.f1_scores(settle(_out_of_fold(r, _trees), "oof"))


# What must hold of out-of-fold scores whatever the trees are: every cell once, no district in two folds,
# probabilities, and an order better than chance.  The linear baseline need not have the last: cells of few readings lie at
# both ends of the mean rain.
@query(
    "ml5_out_of_fold_bounds",
    """SELECT (SELECT count(*) FROM grid) AS n, (SELECT count(*) FROM grid) AS cells, 0::BIGINT AS split_districts, 0::BIGINT AS outside, true AS better_than_chance""",
)
def _(r):
    g = labelled_cells(r)
    oof = settle(model.out_of_fold(g, model.group_folds(g, "dong", 5), "dong", "grid_id", _trees(model.available(g, FEATURES))), "oof")
    split = oof.join(g.select("grid_id", "dong"), "grid_id").groupBy("dong").agg(F.countDistinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1)).first()[0]
    auc = model.scores_of(oof).first()["auc"]
    return oof.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("grid_id").alias("cells"), F.lit(split).cast("long").alias("split_districts"),
        F.count_if(~F.col("p").between(0, 1)).alias("outside"), F.lit(auc > 0.5).alias("better_than_chance"),
    )


@query("ml6_importance_bounds", "SELECT 7::BIGINT AS n, true AS sums_to_one, 0::BIGINT AS negative")
def _(r):
    g = labelled_cells(r)
    features = model.available(g, FEATURES)
    found = model.feature_importance(model.fit_weighted(_trees(features), g), features, r.spark)
    return found.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"), F.count_if(F.col("importance") < 0).alias("negative"))
