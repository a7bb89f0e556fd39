"""Extracted records held against ground truth: exact, then fuzzy, then semantic, then by hand.

Both tables have row_id, recommendation, class and LOE; row_id is the order in which the
first of equals wins. Each stage sees only what the stages before left, and scores
distinct texts once. No side is broadcast by order: Spark does so where its size allows.
Where a scorer allows it, only pairs that can reach the threshold are made, by equi-joins
that lose none; another scorer sees all pairs of distinct texts, as only it can tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from marlstone.functions import nearest
from marlstone.functions.fuzzy import edit_ratio, normal_expr, token_jaccard, token_sort_expr, weighted_ratio
from marlstone.functions.text import choice_kind, same_folded

Scorer = Callable[[Column, Column], Column]
FUZZY, SEMANTIC, CANDIDATES = 95, 0.6, 10
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 32 << 20  # vectors of a block at most, about, and their bytes in double precision
BLOCKS, BLOCK_LEAST = 16, 8192  # more blocks than these limits ask for, so many, if they hold as many vectors each
COLUMNS = (
    *("row_id", "recommendation_text", "recommendation_grade", "recommendation_level", "matched_text"),
    *("grade_eval", "level_eval", "match_score", "manual_validation", "match_stage"),
)


def _result(found: DataFrame, stage: str, text: Column, score: Column, manual: bool = False) -> DataFrame:
    """found: row_id, recommendation, class, LOE of the record, g: struct(class, LOE, …) of its match."""
    return found.select(
        "row_id",
        F.col("recommendation").alias("recommendation_text"),
        F.col("class").alias("recommendation_grade"),
        F.col("LOE").alias("recommendation_level"),
        text.alias("matched_text"),
        same_folded(F.col("class"), F.col("g.class")).alias("grade_eval"),
        same_folded(F.col("LOE"), F.col("g.LOE")).alias("level_eval"),
        score.cast("double").alias("match_score"),
        F.lit(manual).alias("manual_validation"),
        F.lit(stage).alias("match_stage"),
    )


def first_by(gt: DataFrame, key: Column) -> DataFrame:
    """k and g: of the rows of each key the first, as a struct."""
    kept = F.struct("row_id", "recommendation", "class", "LOE")
    return gt.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min_by(kept, "row_id").alias("g"))


def exact_gate(ext: DataFrame, gt: DataFrame) -> DataFrame:
    """Records whose text stands in the ground truth as it is."""
    return ext.join(gt.select("recommendation").distinct(), "recommendation", "left_semi")


def exact_matches(ext: DataFrame, gt: DataFrame) -> DataFrame:
    """Records that pass the gate, with the first row whose text is equal in lower case; score 100."""
    first = first_by(gt, F.lower("recommendation"))
    found = exact_gate(ext, gt).join(first, F.lower("recommendation") == F.col("k"))
    return _result(found, "exact", F.col("recommendation"), F.lit(100))


def _distinct_pairs(ext: DataFrame, first: DataFrame, text: Column) -> DataFrame:
    """q (each distinct text of ext once) with each row of first."""
    return ext.where(text.isNotNull()).select(text.alias("q")).distinct().crossJoin(first)


def fuzzy_top(ext: DataFrame, gt: DataFrame, scorer: Scorer = weighted_ratio, limit: int = CANDIDATES, by: str = "recommendation") -> DataFrame:
    """q, rank, choice, gt_row_id and score: for each distinct lower-case text its best rows, ties by row_id.

    Every pair of distinct texts is scored. Of a text's choices only the best limit, and of
    a choice's rows only the first limit can be among the best rows, so no more are joined.
    """
    texts = gt.where(F.col(by).isNotNull()).select(F.lower(by).alias("choice"), F.col("row_id").alias("gt_row_id"))
    first = texts.groupBy("choice").agg(F.min("gt_row_id").alias("first"))
    scored = _distinct_pairs(ext, first, F.lower(by)).withColumn("score", scorer(F.col("q"), F.col("choice")))
    within = lambda df, key, *order: df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= limit).drop("r")
    scored = within(scored, "q", F.desc("score"), F.col("first")).drop("first")
    texts = within(texts, "choice", F.col("gt_row_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "gt_row_id")
    ranked = scored.join(texts, "choice").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("q", "rank", "choice", "gt_row_id", F.rint("score").alias("score"))


def fuzzy_matches(ext: DataFrame, gt: DataFrame, scorer: Scorer = weighted_ratio, threshold: float = FUZZY) -> DataFrame:
    """Records whose best choice scores at least the threshold once rounded; the choice's text in lower case."""
    if scorer is weighted_ratio and threshold >= FUZZY:
        return blocked_fuzzy_matches(ext, gt, threshold)
    first = first_by(gt, F.lower("recommendation"))
    if scorer is edit_ratio and 50 < threshold <= 100:
        pairs = _near_in_edits(ext, first, threshold)
    else:
        pairs = _distinct_pairs(ext, first, F.lower("recommendation"))
    scored = pairs.withColumn("score", scorer(F.col("q"), F.col("k")))
    best = scored.groupBy("q").agg(F.max_by(F.struct("k", "g", "score"), F.struct("score", -F.col("g.row_id"))).alias("b"))
    return _accepted(ext, best, threshold)


def _near_in_edits(ext: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose edit ratio can reach the threshold once rounded.

    Of n characters in the longer text at most share * n are edited, so the shorter one
    has at least (1 - share) * n: lengths meet in buckets of that width or in neighbouring ones.
    """
    share = (100.5 - threshold) / 100
    width = F.log(F.lit(1 / (1 - share)) + F.lit(1e-9))
    bucket = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / width)
    left = ext.where("recommendation is not null").select(F.lower("recommendation").alias("q")).distinct()
    left = left.withColumn("mst_b", F.explode(F.array(bucket("q") - 1, bucket("q"), bucket("q") + 1)))
    pairs = left.join(first.withColumn("mst_b", bucket("k")), "mst_b").drop("mst_b")
    return pairs.where(F.expr(f"levenshtein(q, k, cast(ceil({share} * greatest(length(q), length(k))) as int)) >= 0"))


def _sharing_tokens(ext: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose token sets can have a Jaccard similarity of the threshold: they share one of the rarest tokens of each.

    Of n tokens the rarest n - ceil(threshold * n) + 1, in one order for all texts, are enough.
    """
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    left = ext.where("recommendation is not null").select(F.col("recommendation").alias("q")).distinct()
    known = first.select(F.explode(tokens("k")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        listed = df.select(c, F.explode(tokens(c)).alias("w")).join(known, "w", "left").groupBy(c)
        listed = listed.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("ws"))
        size = F.size("ws") - F.ceil(F.lit(threshold - 1e-6) * F.size("ws")).cast("int") + 1
        return listed.select(c, F.explode(F.slice("ws", 1, F.least(size, F.size("ws")))).alias("x")).select(c, F.col("x.w").alias("w"))

    return rarest(left, "q").join(rarest(first, "k"), "w").select("q", "k").distinct().join(first, "k")


def _accepted(ext: DataFrame, best: DataFrame, threshold: float) -> DataFrame:
    found = ext.join(best, F.lower("recommendation") == F.col("q")).where(F.rint("b.score") >= threshold).withColumn("g", F.col("b.g"))
    return _result(found, "fuzzy", F.col("b.k"), F.rint("b.score"))


def blocked_fuzzy_matches(ext: DataFrame, gt: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """fuzzy_matches with the weighted ratio, over pairs that can reach a threshold of 95 or more.

    Lengths in ratio 1.5 or more can't. Of others either the edit distance is below
    0.055 of the lengths' sum, so that the lengths are in ratio 1.12 at most and meet in
    neighbouring buckets of that width, or the ratio of the tokens, sorted or as sets,
    is above 99.4: equal bags join on their sorted tokens, and sets of which one holds the
    other, or nearly, share the rarest token of one of them, so tokens join.
    """
    if threshold < FUZZY:
        raise ValueError("the blocks lose no pair only from 95 on")
    first = first_by(gt, F.lower("recommendation"))
    right = first.withColumn("n", normal_expr(F.col("k"))).withColumn("s", token_sort_expr(F.col("k")))
    left = ext.where("recommendation is not null").select(F.lower("recommendation").alias("q")).distinct()
    left = left.withColumn("m", normal_expr(F.col("q"))).withColumn("t", token_sort_expr(F.col("q")))
    left, right = left.where("m <> ''"), right.where("n <> ''")
    bucket = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit(1.125)))
    a = left.withColumn("b", F.explode(F.array(bucket("m") - 1, bucket("m"), bucket("m") + 1)))
    edits = F.expr("levenshtein(m, n, cast(floor(0.055 * (length(m) + length(n))) as int)) >= 0")
    near = a.join(right.withColumn("b", bucket("n")), "b").where(edits).select("q", "k")
    bags = left.join(right, left.t == right.s).select("q", "k")
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    sets = left.withColumn("w", F.explode(tokens("t"))).join(right.withColumn("w", F.explode(tokens("s"))), "w")
    like = F.greatest(F.length("m"), F.length("n")) < 1.5 * F.least(F.length("m"), F.length("n"))
    sets = sets.where(like).select("q", "k").distinct()
    pairs = near.unionByName(bags).unionByName(sets).distinct()
    scored = pairs.withColumn("score", weighted_ratio("q", "k")).join(first, "k")
    best = scored.groupBy("q").agg(F.max_by(F.struct("k", "g", "score"), F.struct("score", -F.col("g.row_id"))).alias("b"))
    return _accepted(ext, best, threshold)


def semantic_best(ext: DataFrame, gt: DataFrame, scorer: Scorer, threshold: float = 0.0) -> DataFrame:
    """q and b (k, g, sim): for each distinct text the row of the greatest similarity, the first of equals. NaN never wins.

    Texts whose best is below the threshold may be left out.
    """
    first = first_by(gt, F.col("recommendation"))
    pairs = _sharing_tokens(ext, first, threshold) if scorer is token_jaccard and threshold > 0 else _distinct_pairs(ext, first, F.col("recommendation"))
    scored = pairs.withColumn("sim", scorer(F.col("q"), F.col("k")).cast("double"))
    scored = scored.where("sim is not null and not isnan(sim)")
    return scored.groupBy("q").agg(F.max_by(F.struct("k", "g", "sim"), F.struct("sim", -F.col("g.row_id"))).alias("b"))


def semantic_matches(ext: DataFrame, gt: DataFrame, scorer: Scorer, threshold: float = SEMANTIC) -> DataFrame:
    """Records whose best similarity reaches the threshold; score is 100 times it, the text that of the ground truth."""
    found = ext.join(semantic_best(ext, gt, scorer, threshold), F.col("recommendation") == F.col("q")).where(F.col("b.sim") >= threshold).withColumn("g", F.col("b.g"))
    return _result(found, "semantic", F.col("b.k"), F.col("b.sim") * 100)


def vector_argmax(queries: DataFrame, data: DataFrame, similarity: Scorer) -> DataFrame:
    """query_id, best_id and sim: for each (id, v) of queries the row of data of another id that is nearest, ties to the least id."""
    pairs = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")).crossJoin(data.select(F.col("id").alias("best_id"), F.col("v").alias("d")))
    scored = pairs.where("query_id <> best_id").select("query_id", "best_id", similarity(F.col("q"), F.col("d")).alias("sim")).where("sim is not null and not isnan(sim)")
    best = F.max_by(F.struct("best_id", "sim"), F.struct("sim", -F.col("best_id"))).alias("b")
    return scored.groupBy("query_id").agg(best).select("query_id", "b.best_id", "b.sim")


def nearest_vectors(queries: DataFrame, data: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vector_argmax by cosine, a block of queries and a block of data at a time, by matrix products; equal similarities are told as DuckDB does.

    Ids are integers. Vectors of zeros, with an entry that is null or no finite number, or of
    another length than those that they meet have no similarity. The number of blocks
    grows with the tables, so that a task's share doesn't; a block is stored once and read
    for each that it meets. Where queries and data are one table, two blocks meet once for both directions.
    """
    mutual = queries is data
    known = lambda df: df.where("id is not null and v is not null and size(v) > 0")
    sizes = [known(df).agg(F.count("*"), F.sum(F.size("v").cast("long"))).first() for df in ([data] if mutual else [queries, data])]
    rows, values = max(r for r, _ in sizes), max(v or 0 for _, v in sizes)
    n = max(1, -(-rows // block_rows), -(-8 * values // BLOCK_BYTES), min(BLOCKS, rows // BLOCK_LEAST))
    single = all(df.schema["v"].dataType.elementType == FloatType() for df in (queries, data))
    kind = np.float32 if single else np.float64

    def packed(table: pa.Table) -> pa.Table:
        ids, v, first = nearest.pack(table["id"].combine_chunks(), table["v"].combine_chunks())
        return pa.table({"d": table["d"][:1], "b": table["b"][:1], "ids": pa.array([ids], pa.binary()), "v": pa.array([v], pa.binary()), "first": pa.array([first], pa.int32())})

    def blocks(df: DataFrame, side: str) -> DataFrame:
        vectors = known(df).select(
            F.size("v").alias("d"),
            F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(n)).cast("int").alias("b"),
            F.col("id").cast("long").alias("id"),
            F.col("v").cast("array<float>" if single else "array<double>").alias("v"),
        )
        made = vectors.groupBy("d", "b").applyInArrow(packed, "d int, b int, ids binary, v binary, first int").repartitionById(n, "b")
        return made.select(*(F.col(c).alias(side + c) for c in ("d", "b", "ids", "v", "first")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                of = lambda name, k=k, batch=batch: batch.column(name)[k].as_py()
                left, right = (nearest.sides(of(s + "ids"), of(s + "v"), of(s + "first"), of("qd"), kind) for s in "qd")
                same = of("qb") == of("db")
                for ids, best, sim in nearest.compare(left, right, same, mutual):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best), pa.array(sim)], ["query_id", "best_id", "sim"])

    meet = F.col("qd") == F.col("dd")
    if mutual:
        meet &= F.col("qb") <= F.col("db")
    pairs = blocks(queries, "q").join(blocks(data, "d").hint("shuffle_replicate_nl"), meet)
    found = pairs.mapInArrow(compare, "query_id bigint, best_id bigint, sim double")
    best = F.max_by(F.struct("best_id", "sim"), F.struct("sim", -F.col("best_id"))).alias("b")
    return found.groupBy("query_id").agg(best).select("query_id", "b.best_id", "b.sim")


def adjudicated_matches(ext: DataFrame, gt: DataFrame, candidates: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Records that somebody judged: adjudications has row_id and choice, the candidate's number from 0.

    The number of candidates means none of them: such a record has no match, and
    manual_validation tells it from those never judged. Whatever is no such number is passed over.
    """
    listed = candidates.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "choice", "score"))).alias("options"))
    judged = ext.join(adjudications.select("row_id", "choice"), "row_id").join(listed, F.lower("recommendation") == F.col("q"))
    judged = judged.withColumn("kind", choice_kind(F.col("choice"), F.size("options")))
    chosen = judged.where("kind = 'accept'").withColumn("o", F.try_element_at("options", (F.col("choice").try_cast("int") + 1)))
    found = chosen.join(first_by(gt, F.lower("recommendation")), F.col("o.choice") == F.col("k"))
    none = unmatched(judged.where("kind = 'none'")).withColumn("manual_validation", F.lit(True))
    return _result(found, "manual", F.col("o.choice"), F.col("o.score"), manual=True).unionByName(none)


def unmatched(ext: DataFrame) -> DataFrame:
    """Records without a match."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return ext.select(
        "row_id",
        F.col("recommendation").alias("recommendation_text"),
        F.col("class").alias("recommendation_grade"),
        F.col("LOE").alias("recommendation_level"),
        none("string", "matched_text"),
        none("boolean", "grade_eval"),
        none("boolean", "level_eval"),
        none("double", "match_score"),
        F.lit(False).alias("manual_validation"),
        F.lit("none").alias("match_stage"),
    )


def cascade(
    ext: DataFrame,
    gt: DataFrame,
    fuzzy: Scorer = weighted_ratio,
    semantic: Scorer | None = None,
    adjudications: DataFrame | None = None,
    fuzzy_threshold: float = FUZZY,
    semantic_threshold: float = SEMANTIC,
) -> DataFrame:
    """One row for each record, from the first stage that finds a match, or none."""
    found = exact_matches(ext, gt)
    left = ext.join(found.select("row_id"), "row_id", "left_anti")
    step = fuzzy_matches(left, gt, fuzzy, fuzzy_threshold)
    found, left = found.unionByName(step), left.join(step.select("row_id"), "row_id", "left_anti")
    if semantic is not None:
        step = semantic_matches(left, gt, semantic, semantic_threshold)
        found, left = found.unionByName(step), left.join(step.select("row_id"), "row_id", "left_anti")
    if adjudications is not None:
        step = adjudicated_matches(left, gt, fuzzy_top(left, gt, fuzzy), adjudications)
        found, left = found.unionByName(step), left.join(step.select("row_id"), "row_id", "left_anti")
    return found.unionByName(unmatched(left)).select(*COLUMNS)


def missing(gt: DataFrame, ext: DataFrame) -> DataFrame:
    """Rows of the ground truth, repeated ones too, whose text is in no record; null is found by null."""
    texts = ext.select(F.col("recommendation").alias("mst_r")).distinct()
    return gt.join(texts, F.col("recommendation").eqNullSafe(F.col("mst_r")), "left_anti")


def containing(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str) -> DataFrame:
    """The distinct (key, item_key) of texts that hold an item character by character.

    Between blanks, all of an item but its first and last token stands in a text as a token,
    so texts and items join on the item's rarest of those, over all texts, and
    are then compared. An item of fewer than three tokens is looked for in every text.
    """
    asked = items.select(F.col(item_key).alias("mst_i"), F.col(item).alias("mst_t")).where("mst_t is not null").distinct()
    tokens = F.array_distinct(F.slice(F.split("mst_t", " ", -1), 2, F.greatest(F.size(F.split("mst_t", " ", -1)) - 2, F.lit(0))))
    asked = asked.withColumn("mst_ws", tokens)
    given = docs.select(F.col(key).alias("mst_k"), F.col(text).alias("mst_d"), F.xxhash64(text).alias("mst_h")).where("mst_d is not null")
    of_texts = given.select("mst_h", F.explode(F.array_distinct(F.split("mst_d", " ", -1))).alias("mst_w"))
    wanted = asked.select(F.explode("mst_ws").alias("mst_w")).distinct()
    known = of_texts.select("mst_w").join(wanted, "mst_w", "left_semi").groupBy("mst_w").agg(F.count("*").alias("n"))
    # an item with a token that no text has is in none
    each = asked.select("mst_i", "mst_t", F.explode("mst_ws").alias("mst_w")).join(known, "mst_w")
    rarest = each.groupBy("mst_i", "mst_t").agg(F.min(F.struct("n", "mst_w")).alias("r")).select("mst_i", "mst_t", F.col("r.mst_w").alias("mst_w"))
    maybe = of_texts.join(rarest, "mst_w").select("mst_h", "mst_i", "mst_t").distinct()  # no text moves with its tokens
    met = given.join(maybe, "mst_h").where(F.col("mst_d").contains(F.col("mst_t"))).select("mst_k", "mst_i")
    short = asked.where(F.size("mst_ws") == 0).select("mst_i", "mst_t")
    if not short.isEmpty():
        met = met.unionByName(given.join(short, F.col("mst_d").contains(F.col("mst_t"))).select("mst_k", "mst_i"))
    return met.distinct().select(F.col("mst_k").alias(key), F.col("mst_i").alias(item_key))
