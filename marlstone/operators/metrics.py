"""Accuracies of matched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracies(matches: DataFrame) -> DataFrame:
    """One row: counts, and three accuracies in percent.

    Recommendations are measured against all records, grade and level against the
    matched ones: 0 if none is matched. Without records the first is null.
    """
    matched = F.col("match_stage") != "none"
    counted = matches.agg(
        F.count("*").alias("n_records"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(F.col("grade_eval")).alias("n_grade"),
        F.count_if(F.col("level_eval")).alias("n_level"),
    )
    return counted.withColumns(
        {
            "accuracy_recommendation": share(F.col("n_matched"), F.col("n_records")),
            "accuracy_grade": F.coalesce(share(F.col("n_grade"), F.col("n_matched")), F.lit(0.0)),
            "accuracy_level": F.coalesce(share(F.col("n_level"), F.col("n_matched")), F.lit(0.0)),
        }
    )


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, null if the whole is 0."""
    return F.try_divide(part * F.lit(100.0), whole)
