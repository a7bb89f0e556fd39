"""One query for each operator over its whole table, and SQL for those that SQL can express.

Each query reads its tables by path, so that Spark prunes columns; none takes a
subset of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, licenses, line_dedup, near_dedup, neighbours, ngram_lm, pieces, reshard, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a classifier that this table's confirmed toxic documents taught."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors, for every vector whose id is divisible by 100."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries="vec_id % 100 = 0")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licences that documents name."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of all of them."""
    docs = _table(spark, sf_dir, "documents")
    return ngram_lm.perplexity(docs, ngram_lm.train(docs))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that are exact or near copies of others, with their groups."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, after the table's files became a quarter more shards of equal size."""
    table, _ = reshard.reshard(spark, f"{sf_dir}/documents.parquet")
    return table.select("doc_id", "shard", "rewritten")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether they decode to its text."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that came before, of a store with all the ways to change it.

    Documents with even ids come first, those with odd ids after them, a quarter is deleted and
    comes again, so that filters and counts are probed, added to and taken from.
    """
    return line_dedup.maintained(_table(spark, sf_dir, "documents"), "doc_id % 2 <> 0", "doc_id % 4 = 0")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_nearest_neighbours, op4_license_scan, op5_decontamination, op6_lm_scoring, op7_near_dedup, op8_resharding, op9_sentencepiece, op10_line_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licenses.oracle_sql(),
    "op5_decontamination": decontaminate.oracle_sql(),
    "op10_line_dedup": r"""
        WITH numbered AS (
          SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k,
                 CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 2 <> 0 THEN 2 ELSE 1 END AS came
          FROM documents),
        lines AS (
          SELECT k, came, doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos
          FROM numbered),
        marked AS (
          SELECT *, NOT regexp_matches(line, '\S')
                    OR row_number() OVER (PARTITION BY line ORDER BY came, doc_id, pos) = 1 AS stays
          FROM lines),
        put AS (
          SELECT k, string_agg(line, chr(10) ORDER BY pos) FILTER (stays) AS text,
                 count(*) FILTER (NOT stays) AS n_dropped
          FROM marked GROUP BY k)
        SELECT n.doc_id, CASE WHEN n.text IS NULL THEN NULL ELSE coalesce(p.text, '') END AS text,
               CAST(coalesce(p.n_dropped, 0) AS INTEGER) AS n_dropped
        FROM numbered n LEFT JOIN put p USING (k)""".replace("\\\\", "\\"),
}
