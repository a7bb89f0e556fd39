"""Samples and splits of exact size, the same on every run.

Rows are ordered by a hash of their key and a seed, and by the key itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PRIME, _SIZE = 2654435761, 1 << 32
_RANGES = 1 << 16  # a row for each is sent to all tasks: 1 MB; a billion rows make ranges of 15,000


def order_of(key: str, seed: int = 42) -> Column:
    """A pseudo-random number below 2**32 of an integer key, in plain arithmetic."""
    return F.pmod(F.pmod(F.col(key).cast("bigint") + seed, F.lit(_SIZE)) * F.lit(_PRIME), F.lit(_SIZE))


def _ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds mst_at, from 1. Positions are counted in ranges of the order, side by side, and carried over."""
    placed = df.withColumn("mst_o", order_of(key, seed)).withColumn("mst_b", F.floor(F.col("mst_o") / (_SIZE // _RANGES)).cast("int"))
    sizes = placed.groupBy("mst_b").agg(F.count("*").alias("c"))
    before = Window.orderBy("mst_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("mst_b").alias("mst_r"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("mst_c"))  # a row for each range
    inside = Window.partitionBy("mst_b").orderBy("mst_o", key, F.xxhash64(*df.columns))
    joined = placed.join(F.broadcast(sizes), placed.mst_b.eqNullSafe(sizes.mst_r))
    return joined.withColumn("mst_at", F.row_number().over(inside) + F.col("mst_c")).drop("mst_o", "mst_b", "mst_r", "mst_c")


def sample_exact(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """round(n * share) rows, half to even, with a new row_id from 0."""
    total = df.agg(F.rint(F.count("*") * F.lit(share)).alias("mst_n"))
    kept = _ranked(df, key, seed).join(F.broadcast(total)).where(F.col("mst_at") <= F.col("mst_n"))  # one row
    return kept.withColumn("row_id", (F.col("mst_at") - 1).cast("bigint")).drop("mst_at", "mst_n")


def split_exact(df: DataFrame, key: str, holdout: float = 0.3, test: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds split: of ceil(n * holdout) rows ceil(test of them) are test and the others val; all else is train."""
    held = F.ceil(F.round(F.count("*") * F.lit(holdout), 9))
    total = df.agg(held.alias("mst_h")).withColumn("mst_t", F.ceil(F.round(F.col("mst_h") * F.lit(test), 9)))
    name = F.when(F.col("mst_at") <= F.col("mst_t"), "test").when(F.col("mst_at") <= F.col("mst_h"), "val").otherwise("train")
    return _ranked(df, key, seed).join(F.broadcast(total)).withColumn("split", name).drop("mst_at", "mst_h", "mst_t")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in a pseudo-random order."""
    return df.orderBy(order_of(key, seed), key)


def training_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs under the names that training wants."""
    return pairs.withColumnsRenamed({"sentence1": "text1", "sentence2": "text2", "score": "label"}).select("text1", "text2", "label")
