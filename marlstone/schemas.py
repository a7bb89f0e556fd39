"""The tables that go in and come out, with types declared rather than inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RECOMMENDATIONS = _struct(**{"recommendation": S, "class": S, "LOE": S})
PARSED = _struct(**{"id": S, "recommendation": S, "class": S, "LOE": S})
PAIRS = _struct(id=S, sentence1=S, sentence2=S, score=D)
MATCHES = _struct(
    recommendation_text=S, recommendation_grade=S, recommendation_level=S, matched_text=S, grade_eval=B, level_eval=B, match_score=D, manual_validation=B
)
METRICS = _struct(accuracy_recommendation=D, accuracy_grade=D, accuracy_level=D, n_missing_recommendations=L)
MODEL_RESULTS = _struct(model=S, pearson_correlation=D, auc=D, youden_index=D, retrained=B)
ADJUDICATIONS = _struct(row_id=L, choice=S)

#: What a prompt asks a model for about a meta-analysis; nothing parses the answers.
STUDY_FIELDS = ("population", "n_patients", "setting", "n_studies", "symptom", "diagnosis", "diagnostic_tool", "reference_standard")
ACCURACY_FIELDS = (
    *("fp", "fn", "tp", "tn", "prevalence", "prevalence_ci_low", "prevalence_ci_high"),
    *("sensitivity", "sensitivity_ci_low", "sensitivity_ci_high", "sensitivity_i2", "sensitivity_p"),
    *("specificity", "specificity_ci_low", "specificity_ci_high", "specificity_i2", "specificity_p", "auc", "auc_ci"),
)
CONFIDENCE = ("green", "yellow", "red")
STRENGTHS = ("strong recommendation against", "strong recommendation", "conditional recommendation", "conditional recommendation against")
CERTAINTIES = ("high", "moderate", "low", "very low")
