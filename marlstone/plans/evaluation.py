"""The two evaluations from end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.fuzzy import weighted_ratio
from marlstone.models import NATIVE, SimilarityModel, long_scores, wide
from marlstone.operators import match, metrics, roc, sampling


@dataclass(frozen=True)
class Evaluation:
    """metrics (one row), matches, the rows of the ground truth never extracted, and candidates for whoever adjudicates."""

    metrics: DataFrame
    matches: DataFrame
    missing: DataFrame
    candidates: DataFrame


def evaluate_extraction(
    ext: DataFrame, gt: DataFrame, semantic: match.Scorer | None = None, adjudications: DataFrame | None = None, fuzzy: match.Scorer = weighted_ratio
) -> Evaluation:
    """Extracted records against the ground truth. Matches are used four times: cache them for a large input.

    Adjudication takes two runs: the first gives candidates for what has no match, the
    second takes the choices as a table.
    """
    matches = match.cascade(ext, gt, fuzzy, semantic, adjudications)
    gone = match.missing(gt, ext)
    n = gone.agg(F.count("*").alias("n_missing_recommendations"))
    made = metrics.accuracies(matches).crossJoin(n)  # one row each
    left = ext.join(matches.where("match_stage = 'none'").select("row_id"), "row_id", "left_semi")
    figures = made.select("accuracy_recommendation", "accuracy_grade", "accuracy_level", "n_missing_recommendations")
    return Evaluation(figures, matches, gone, match.fuzzy_top(left, gt, fuzzy))


def combine_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sets of pairs, by column name, columns that one lacks as null, with new row_ids."""
    both = first.drop("row_id").unionByName(second.drop("row_id"), allowMissingColumns=True)
    return both.withColumn("row_id", F.monotonically_increasing_id())


def evaluate_models(
    pairs: DataFrame, models: tuple[SimilarityModel, ...] = NATIVE, testing: bool = False, retrain: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Results by model, and the pairs with a column of scores for each model.

    testing takes a hundredth of the pairs; retrain trains the models that can be, on
    the training part, and measures all on the test part.
    """
    if testing:
        pairs = sampling.sample_exact(pairs.drop("row_id").withColumn("mst_k", F.xxhash64("sentence1", "sentence2", "score")), "mst_k", 0.01).drop("mst_k")
    if retrain:
        parts = sampling.split_exact(pairs, "row_id")
        train, val = (sampling.training_pairs(parts.where(F.col("split") == s)) for s in ("train", "val"))
        models = tuple(m.train(train, val) if m.train is not None else m for m in models)
        pairs = parts.where("split = 'test'").drop("split")
    scores = long_scores(pairs, models)
    return roc.evaluate(scores, retrained=retrain), pairs.join(wide(scores, [m.name for m in models]), "row_id", "left")
