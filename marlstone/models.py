"""Similarity models: what is needed of one, a registry, and native ones.

Neural models are not part of the engine. Whoever has one registers an adapter:
score gives an expression over two text columns, usually a pandas UDF that loads
the model once for each worker; embed, if there is one, lets texts be encoded once each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.fuzzy import edit_ratio, token_jaccard, weighted_ratio
from marlstone.functions.vectors import cosine


@dataclass(frozen=True)
class SimilarityModel:
    """name, and how a pair is scored: by an expression or through embeddings."""

    name: str
    score: Callable[[Column, Column], Column] | None = None
    embed: Callable[[pd.Series], pd.Series] | None = None
    train: Callable[[DataFrame, DataFrame], SimilarityModel] | None = None
    prompts: dict[str, str] = field(default_factory=dict)  # literal prefixes for embeddings

    @property
    def trainable(self) -> bool:
        return self.train is not None

    def with_prompt(self, name: str) -> SimilarityModel:
        """The model with a prompt of its list before each text."""
        prefix, inner = self.prompts[name], self.embed
        if inner is None:
            raise ValueError(f"{self.name} has no embeddings")
        return SimilarityModel(self.name, None, lambda texts: inner(prefix + texts), self.train, self.prompts)

    def add_to(self, pairs: DataFrame, left: str = "sentence1", right: str = "sentence2") -> DataFrame:
        """The pairs with pred. With embeddings, each distinct text is encoded once."""
        if self.score is not None:
            return pairs.withColumn("pred", self.score(F.col(left), F.col(right)).cast("double"))
        encode = self.embed
        if encode is None:
            raise ValueError(f"{self.name} has neither a score nor embeddings")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"t": batch["t"], "v": list(encode(batch["t"]))})

        texts = pairs.select(F.col(left).alias("t")).union(pairs.select(right)).where("t is not null").distinct()
        vectors = texts.mapInPandas(run, "t string, v array<float>")
        a, b = (vectors.select(F.col("t").alias(f"t{k}"), F.col("v").alias(f"v{k}")) for k in (1, 2))
        joined = pairs.join(a, F.col(left) == F.col("t1"), "left").join(b, F.col(right) == F.col("t2"), "left")
        return joined.withColumn("pred", cosine(F.col("v1"), F.col("v2"))).drop("t1", "t2", "v1", "v2")


NATIVE = (
    SimilarityModel("edit_ratio", edit_ratio),
    SimilarityModel("token_jaccard", token_jaccard),
    SimilarityModel("weighted_ratio", lambda a, b: weighted_ratio(a, b)),
)


def long_scores(pairs: DataFrame, models: tuple[SimilarityModel, ...] = NATIVE) -> DataFrame:
    """row_id, model, pred, score: a row for each pair and model."""
    parts = [m.add_to(pairs).select("row_id", F.lit(m.name).alias("model"), "pred", "score") for m in models]
    return reduce(DataFrame.unionByName, parts)


def melt(pairs: DataFrame, columns: dict[str, str], score: str, key: str) -> DataFrame:
    """Long form of columns that already hold predictions: {model: column}. One scan."""
    made = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred")) for m, c in columns.items()))).alias("x")
    return pairs.select(F.col(key).alias("row_id"), F.col(score).cast("double").alias("score"), made).select("row_id", "x.model", "x.pred", "score")


def wide(scores: DataFrame, models: list[str]) -> DataFrame:
    """row_id and a column for each model."""
    return scores.groupBy("row_id").pivot("model", models).agg(F.first("pred"))
