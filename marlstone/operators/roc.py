"""Correlation, area under the ROC curve, and the cutoff of the greatest Youden index, by model.

Scores come in long form: model, pred, score. Equal predictions are counted together
first; cumulative counts are made within buckets of a model's predictions and carried
over from bucket to bucket, so that no task holds all predictions of a model. Null or NaN predictions and scores are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POSITIVE = 3.0
BUCKETS = 256


def binarise(score: Column, least: float = POSITIVE) -> Column:
    """1 if the score is at least so high, else 0; NaN is 0, null stays null."""
    return ((score >= least) & ~F.isnan(score.cast("double"))).cast("int")


def usable(scores: DataFrame) -> DataFrame:
    keep = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("pred", "score")]
    return scores.where(keep[0] & keep[1]).withColumn("pred", F.col("pred").cast("double")).withColumn("score", F.col("score").cast("double"))


def pearson(scores: DataFrame) -> DataFrame:
    """model, pearson_correlation: NaN if a side is constant, null without two rows."""
    spread = F.stddev_pop("pred") * F.stddev_pop("score")
    made = usable(scores).groupBy("model").agg(F.covar_pop("pred", "score").alias("c"), spread.alias("s"), F.count("*").alias("n"))
    value = F.when(F.col("n") < 2, None).when(F.col("s") > 0, F.try_divide("c", "s")).otherwise(F.lit(float("nan")))
    return made.select("model", value.alias("pearson_correlation"))


def counts(scores: DataFrame, least: float = POSITIVE) -> DataFrame:
    """model, pred, pos and neg, and how many of either have a lesser prediction (pos_below, neg_below) or there are (p, n)."""
    y = binarise(F.col("score"), least)
    each = usable(scores).groupBy("model", "pred").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cuts = [k / BUCKETS for k in range(1, BUCKETS)]
    bounds = each.groupBy("model").agg(F.array_distinct(F.percentile_approx("pred", cuts, 10_000)).alias("cuts"))
    each = each.join(bounds, "model").withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("pred")))).drop("cuts")
    totals = each.groupBy("model", "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    before = Window.partitionBy("model").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("model")
    carried = totals.select(
        *("model", "bucket"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bp", "bn")),
        F.sum("bp").over(whole).alias("p"),
        F.sum("bn").over(whole).alias("n"),
    )
    inside = Window.partitionBy("model", "bucket").orderBy("pred").rowsBetween(Window.unboundedPreceding, -1)
    made = each.join(carried, ["model", "bucket"])
    below = {f"{k}_below": F.col(f"{b}_before") + F.coalesce(F.sum(k).over(inside), F.lit(0)) for k, b in (("pos", "bp"), ("neg", "bn"))}
    return made.withColumns(below).select("model", "pred", "pos", "neg", "pos_below", "neg_below", "p", "n")


def auc_of(counted: DataFrame) -> DataFrame:
    """model, auc: the chance that a positive is ahead of a negative, ties for half; null with one class."""
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    made = counted.groupBy("model").agg(area.alias("a"), F.first("p").alias("p"), F.first("n").alias("n"))
    return made.select("model", F.try_divide(F.col("a"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def points_of(counted: DataFrame) -> DataFrame:
    """model, threshold, fpr, tpr: from the point above all predictions (threshold infinite) to the least one; null rates with one class."""
    rate = lambda part, below, whole: F.try_divide((F.col(whole) - F.col(below)).cast("double"), F.col(whole))
    each = counted.select("model", F.col("pred").alias("threshold"), rate("neg", "neg_below", "n").alias("fpr"), rate("pos", "pos_below", "p").alias("tpr"))
    zero = lambda whole: F.when(F.col(whole) > 0, F.lit(0.0))
    top = counted.groupBy("model").agg(F.first("p").alias("p"), F.first("n").alias("n"))
    top = top.select("model", F.lit(float("inf")).alias("threshold"), zero("n").alias("fpr"), zero("p").alias("tpr"))
    return each.unionByName(top)


def youden_of(points: DataFrame) -> DataFrame:
    """model, youden_index: the threshold at which tpr - fpr is greatest, of equals the greatest; infinite if none is above 0, null with one class."""
    j = (F.col("tpr") - F.col("fpr")).alias("j")
    best = points.where("tpr is not null and fpr is not null").groupBy("model").agg(F.max(F.struct(j, "threshold")).alias("b"))
    return points.select("model").distinct().join(best, "model", "left").select("model", F.col("b.threshold").alias("youden_index"))


def evaluate(scores: DataFrame, least: float = POSITIVE, retrained: bool = False) -> DataFrame:
    """A row for each model: pearson_correlation, auc, youden_index (a threshold) and the run's flag."""
    counted = counts(scores, least)
    made = pearson(scores).join(auc_of(counted), "model", "left").join(youden_of(points_of(counted)), "model", "left")
    return made.select("model", "pearson_correlation", "auc", "youden_index", F.lit(retrained).alias("retrained"))
