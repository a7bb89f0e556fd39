"""CSV files and console lines; only here do missing values become -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_sentinels(matches: DataFrame) -> DataFrame:
    """Matches as strings, -1 where a record has no match, without the columns for internal use."""
    none = F.col("match_stage") == "none"
    cells = {c: F.when(none, F.lit("-1")).otherwise(F.col(c).cast("string")) for c in ("matched_text", "grade_eval", "level_eval", "match_score")}
    return matches.withColumns(cells).drop("match_stage", "row_id")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder with one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_matches(matches: DataFrame, folder: str) -> None:
    write_csv(with_sentinels(matches), f"{folder}/all_matches.csv")


def write_missing(missing: DataFrame, folder: str) -> None:
    write_csv(missing.drop("row_id"), f"{folder}/missing_recommendations.csv")


def write_model_results(results: DataFrame, folder: str) -> None:
    write_csv(results, f"{folder}/similarity_model_evaluation_results.csv")


def write_scores(wide: DataFrame, folder: str) -> None:
    write_csv(wide, f"{folder}/dataset_with_similarity_scores.csv")


def metric_lines(metrics: DataFrame) -> DataFrame:
    """The four figures as lines to print; n/a where there is none."""
    percent = lambda c: F.when(c.isNull(), "n/a").otherwise(F.format_string("%.2f%%", c))
    return metrics.select(
        F.posexplode(
            F.array(
                F.concat(F.lit("Recommendation accuracy: "), percent(F.col("accuracy_recommendation"))),
                F.concat(F.lit("Grade accuracy: "), percent(F.col("accuracy_grade"))),
                F.concat(F.lit("Level accuracy: "), percent(F.col("accuracy_level"))),
                F.concat(F.lit("Missing recommendations: "), F.col("n_missing_recommendations").cast("string")),
            )
        ).alias("pos", "line")
    )
