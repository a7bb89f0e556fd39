"""The reference operators as queries over the driver's tables, each with SQL for the same rows.

Stand-ins, always whole tables: labelled documents are the extracted records and all other
documents the ground truth, so that only copies match; parts with their names written in five ways are the records
of the cascade and parts its ground truth; labels joined with documents are scored pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import csv_text, fuzzy, text
from marlstone.models import NATIVE, melt, wide
from marlstone.operators import match, metrics, roc, sampling
from marlstone.plans import extraction
from marlstone.plans.evaluation import evaluate_extraction, evaluate_models
from marlstone.sources import pages, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _records(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("recommendation"), F.col("lang").alias("class"), F.col("source").alias("LOE"))


def _gt(spark: SparkSession, sf: str) -> DataFrame:
    return _records(_t(spark, sf, "documents").join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti"))


def _ext(spark: SparkSession, sf: str) -> DataFrame:
    return _records(_t(spark, sf, "documents").join(_t(spark, sf, "labels").select("doc_id"), "doc_id"))


_DOC_SQL = """
    gt AS (SELECT doc_id AS row_id, text AS recommendation, lang AS class, source AS LOE FROM documents d
           WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
    ext AS (SELECT d.doc_id AS row_id, d.text AS recommendation, d.lang AS class, d.source AS LOE
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    first AS (SELECT * FROM gt QUALIFY row_number() OVER (PARTITION BY lower(recommendation) ORDER BY row_id) = 1),
    exact AS (SELECT e.row_id, e.recommendation AS matched_text, lower(e.class) = lower(f.class) AS grade_eval,
                     lower(e.LOE) = lower(f.LOE) AS level_eval
              FROM ext e JOIN first f ON lower(e.recommendation) = lower(f.recommendation)
              WHERE EXISTS (SELECT 1 FROM gt g WHERE g.recommendation = e.recommendation))"""


def _part_gt(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("recommendation"), F.col("p_brand").alias("class"), F.col("p_type").alias("LOE"))


def _part_ext(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    written = (
        F.when(F.col("p_type") == "ECONOMY", F.col("p_name"))
        .when(F.col("p_type") == "SMALL", F.upper("p_name"))
        .when(F.col("p_type") == "MEDIUM", F.concat(last, F.lit(" "), first))
        .when(F.col("p_type") == "PROMO", F.concat("p_name", F.lit(" promo")))
        .otherwise(F.concat(F.lit("other "), "p_brand"))
    )
    return p.select(F.col("p_partkey").alias("row_id"), written.alias("recommendation"), F.col("p_brand").alias("class"), F.lower("p_type").alias("LOE"))


_PART_SQL = """
    gt AS (SELECT p_partkey AS row_id, p_name AS recommendation, p_brand AS class, p_type AS LOE FROM part),
    ext AS (SELECT p_partkey AS row_id, CASE p_type WHEN 'ECONOMY' THEN p_name WHEN 'SMALL' THEN upper(p_name)
              WHEN 'MEDIUM' THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
              WHEN 'PROMO' THEN p_name || ' promo' ELSE 'other ' || p_brand END AS recommendation,
              p_brand AS class, lower(p_type) AS LOE FROM part),
    firstl AS (SELECT lower(recommendation) AS k, * FROM gt QUALIFY row_number() OVER (PARTITION BY lower(recommendation) ORDER BY row_id) = 1),
    first AS (SELECT * FROM gt QUALIFY row_number() OVER (PARTITION BY recommendation ORDER BY row_id) = 1),
    exact AS (SELECT e.*, e.recommendation AS matched_text, f.class AS gc, f.LOE AS gl, 100.0 AS match_score, 'exact' AS match_stage
              FROM ext e JOIN firstl f ON lower(e.recommendation) = f.k
              WHERE e.recommendation IN (SELECT recommendation FROM gt)),
    left1 AS (SELECT * FROM ext WHERE row_id NOT IN (SELECT row_id FROM exact)),
    f1 AS (SELECT q, f.k, f.class AS gc, f.LOE AS gl, f.row_id AS g_id,
             round(100.0 * (1.0 - levenshtein(q, f.k) / greatest(length(q), length(f.k), 1)), 6) AS score
           FROM (SELECT DISTINCT lower(recommendation) AS q FROM left1) CROSS JOIN firstl f),
    f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, g_id) = 1),
    fuzzy AS (SELECT l.*, f2.k AS matched_text, gc, gl, round_even(score, 0) AS match_score, 'fuzzy' AS match_stage
              FROM left1 l JOIN f2 ON lower(l.recommendation) = f2.q WHERE round_even(score, 0) >= 95),
    left2 AS (SELECT * FROM left1 WHERE row_id NOT IN (SELECT row_id FROM fuzzy)),
    s1 AS (SELECT q, f.recommendation AS k, f.class AS gc, f.LOE AS gl, f.row_id AS g_id,
             round(len(list_intersect(string_split(q, ' '), string_split(f.recommendation, ' ')))
                   / len(list_distinct(string_split(q, ' ') || string_split(f.recommendation, ' '))), 6) AS sim
           FROM (SELECT DISTINCT recommendation AS q FROM left2) CROSS JOIN first f),
    s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, g_id) = 1),
    semantic AS (SELECT l.*, s2.k AS matched_text, gc, gl, sim * 100 AS match_score, 'semantic' AS match_stage
                 FROM left2 l JOIN s2 ON l.recommendation = s2.q WHERE sim >= 0.6),
    rest AS (SELECT *, NULL AS matched_text, NULL AS gc, NULL AS gl, NULL AS match_score, 'none' AS match_stage
             FROM left2 WHERE row_id NOT IN (SELECT row_id FROM semantic)),
    matches AS (SELECT row_id, recommendation AS recommendation_text, matched_text,
                       CASE WHEN match_stage <> 'none' THEN lower(class) = lower(gc) END AS grade_eval,
                       CASE WHEN match_stage <> 'none' THEN lower(LOE) = lower(gl) END AS level_eval, match_score, match_stage
                FROM (SELECT * FROM exact UNION ALL BY NAME SELECT * FROM fuzzy UNION ALL BY NAME SELECT * FROM semantic UNION ALL BY NAME SELECT * FROM rest))"""

# the weighted ratio of all pairs (q, k) in wanted: the comparisons that it takes the best of, and the longest
# common subsequence of each by one step of bits for each character of the right string; for up to 100 ASCII characters
_WEIGHTED_SQL = r"""
    plain AS (SELECT q, k, trim(regexp_replace(q, '[^a-z0-9]', ' ', 'g')) AS a, trim(regexp_replace(k, '[^a-z0-9]', ' ', 'g')) AS b FROM wanted),
    tokens AS (
      SELECT *, list_filter(string_split(a, ' '), lambda t: t <> '') AS x, list_filter(string_split(b, ' '), lambda t: t <> '') AS y,
             greatest(length(a), length(b))::DOUBLE / least(length(a), length(b)) AS far FROM plain WHERE a <> '' AND b <> ''),
    bags AS (
      SELECT *, array_to_string(list_sort(x), ' ') AS sx, array_to_string(list_sort(y), ' ') AS sy,
             array_to_string(list_sort(list_distinct(x)), ' ') AS dx, array_to_string(list_sort(list_distinct(y)), ' ') AS dy,
             array_to_string(list_sort(list_intersect(list_distinct(x), y)), ' ') AS common,
             array_to_string(list_sort(list_filter(list_distinct(x), lambda t: NOT list_contains(y, t))), ' ') AS lx,
             array_to_string(list_sort(list_filter(list_distinct(y), lambda t: NOT list_contains(x, t))), ' ') AS ly,
             CASE WHEN far < 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale FROM tokens),
    comparisons AS (
      SELECT q, k, 1.0::DOUBLE AS f, a AS s, b AS t FROM bags
      UNION ALL SELECT q, k, 0.95::DOUBLE, sx, sy FROM bags WHERE far < 1.5
      UNION ALL SELECT q, k, 0.95::DOUBLE, '=', '=' FROM bags WHERE far < 1.5 AND common <> '' AND (lx = '' OR ly = '')
      UNION ALL SELECT q, k, 0.95::DOUBLE, trim(common || ' ' || lx), trim(common || ' ' || ly) FROM bags WHERE far < 1.5
      UNION ALL SELECT q, k, 0.95::DOUBLE, common, trim(common || ' ' || lx) FROM bags WHERE far < 1.5 AND common <> ''
      UNION ALL SELECT q, k, 0.95::DOUBLE, common, trim(common || ' ' || ly) FROM bags WHERE far < 1.5 AND common <> ''
      UNION ALL SELECT q, k, 0.95::DOUBLE * scale, '=', '=' FROM bags WHERE far >= 1.5 AND common <> ''
      UNION ALL SELECT q, k, f, s, substr(t, greatest(p, 0) + 1, least(length(t), p + length(s)) - greatest(p, 0)) FROM (
        SELECT q, k, f, s, t, unnest(range(1 - length(s), length(t))) AS p FROM (
          SELECT q, k, f, CASE WHEN length(s) > length(t) THEN t ELSE s END AS s, CASE WHEN length(s) > length(t) THEN s ELSE t END AS t FROM (
            SELECT q, k, scale AS f, a AS s, b AS t FROM bags WHERE far >= 1.5
            UNION ALL SELECT q, k, 0.95::DOUBLE * scale, sx, sy FROM bags WHERE far >= 1.5 AND common = ''
            UNION ALL SELECT q, k, 0.95::DOUBLE * scale, dx, dy FROM bags WHERE far >= 1.5 AND common = '')))),
    masks AS (
      SELECT s, t, (1::HUGEINT << length(s)) - 1 AS full_, list_transform(string_split(t, ''), lambda c:
               list_sum(list_transform(range(length(s)), lambda i: CASE WHEN s[i + 1] = c THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END))::HUGEINT) AS ms
      FROM (SELECT DISTINCT s, t FROM comparisons WHERE s <> '' AND t <> '')),
    lcs AS (
      SELECT s, t, length(s) - bit_count(list_reduce(list_concat([full_], ms), lambda r, m: ((r + (r & m)) | (r - (r & m))) & full_)) AS n FROM masks),
    weighted AS (
      SELECT q, k, max(f * coalesce(200.0::DOUBLE * n / (length(s) + length(t)), 0)) AS score
      FROM comparisons LEFT JOIN lcs USING (s, t) GROUP BY q, k)"""

_MATCH = ["row_id", "recommendation_text", "matched_text", "grade_eval", "level_eval", "match_score", "match_stage"]


# scans, projections, filters


@query("SELECT doc_id AS id, text AS text1, lang AS grade, source AS level, n_chars AS size FROM documents")
def scan_project_rename(spark: SparkSession, sf: str) -> DataFrame:
    names = {"doc_id": "id", "text": "text1", "lang": "grade", "source": "level", "n_chars": "size"}
    return _t(spark, sf, "documents").select(*names).withColumnsRenamed(names)


@query("SELECT doc_id, CAST(quality * 3 + toxic >= 3 AS INTEGER) AS label FROM labels")
def binarise_label(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "labels").select("doc_id", roc.binarise(F.col("quality") * 3 + F.col("toxic")).alias("label"))


@query(
    "SELECT conv_id, turn, r AS response FROM (SELECT *, CASE role WHEN 'system' THEN 'Sorry: NO Recommendation found. ' ELSE '' END || text AS r FROM conversations) "
    "WHERE NOT contains(lower(r), 'no recommendation found')"
)
def sentinel_filter(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("role") == "system", "Sorry: NO Recommendation found. ").otherwise("")
    turns = _t(spark, sf, "conversations").withColumn("response", F.concat(said, "text"))
    return turns.where(~text.is_empty_answer(F.col("response"))).select("conv_id", "turn", "response")


@query("SELECT doc_id, replace(replace(text, 'Released under the ', ''), 'License.', '') AS stripped FROM documents")
def strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.strip_literals(F.col("text"), ("Released under the ", "License.")).alias("stripped"))


@query("SELECT doc_id, length(text) AS n_characters, length(text) * 3 AS context FROM documents")
def size_proxy(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.length("text").alias("n_characters"), text.token_estimate(F.col("text")).alias("context"))


_PROMPT = text.PROMPT_HEAD.replace("'", "''")


@query(f"SELECT conv_id, turn, '{_PROMPT}' || text AS prompt FROM conversations")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.extraction_prompt(F.col("text")).alias("prompt"))


@query("SELECT doc_id, n_fields.task, 'Read the study below and give its ' || task || ' with a confidence of green, yellow or red.' || chr(10) || chr(10) || 'Study:' || chr(10) || text AS prompt FROM documents, (VALUES ('population'), ('n_patients')) n_fields(task)")
def doc_task_cross(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("page_content"))
    tasks = tables.constants(spark, "task", ("population", "n_patients"))
    return extraction.ask_fields(docs, tasks).withColumnRenamed("doc", "doc_id")


@query("SELECT doc_id, text, NULL AS url FROM documents UNION ALL BY NAME SELECT page_id AS doc_id, html AS text, url FROM pages")
def union_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return docs.unionByName(_t(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url"), allowMissingColumns=True)


# pages and tables


@query("SELECT doc_id AS doc, CAST(unnest(range(len(x))) AS INTEGER) AS page, unnest(x) AS page_content FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)")
def page_explode(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_explode(_t(spark, sf, "documents"), "doc_id", "text")


@query("SELECT conv_id AS doc, string_agg(text, chr(10) ORDER BY turn) AS page_content, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def doc_single(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("text").alias("page_content"))
    return pages.doc_single(turns)


@query(
    "SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS item_no, regexp_replace(unnest(x), '<[^>]*>', '', 'g') AS item "
    "FROM (SELECT page_id, regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 's') AS x FROM pages)"
)
def html_items(spark: SparkSession, sf: str) -> DataFrame:
    return pages.html_items(_t(spark, sf, "pages"))


@query(
    r"""WITH lists AS (SELECT page_id, unnest(x) AS list, generate_subscripts(x, 1) - 1 AS table_no
                  FROM (SELECT page_id, regexp_extract_all(html, '<[uo]l[^>]*>(.*?)</[uo]l>', 1, 's') AS x FROM pages)),
    items AS (SELECT page_id, table_no, unnest(x) AS item, generate_subscripts(x, 1) - 1 AS row_no
              FROM (SELECT page_id, table_no, regexp_extract_all(list, '<li[^>]*>(.*?)</li>', 1, 's') AS x FROM lists))
    SELECT page_id AS doc, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no,
           [replace(replace(replace(trim(regexp_replace(regexp_replace(item, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')] AS cells
    FROM items"""
)
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract_tables(_t(spark, sf, "pages"), "page_id", "html")


def _quoted(c: str) -> Column:
    """The text as one quoted cell of one line."""
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("'"), F.lit("''")), F.lit("'"))


@query(
    "SELECT conv_id AS doc, CAST(turn AS INTEGER) AS page, '0' AS id, replace(text, chr(10), ' ') AS recommendation, 'strong recommendation' AS class, 'high' AS LOE FROM conversations"
)
def csv_parse(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations")
    answer = F.concat(F.lit("0, "), _quoted("text"), F.lit(", 'strong recommendation', 'high'"))
    keyed = turns.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), answer.alias("answer"))
    rows = csv_text.from_csv_lines(keyed, "key", "answer")
    return rows.join(keyed.select("key", "doc", "page"), "key").select("doc", "page", "id", "recommendation", "class", "LOE")


@query(
    "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'arity' WHEN 'user' THEN 'ok' ELSE 'malformed' END AS status, "
    "CASE role WHEN 'user' THEN replace(text, chr(10), ' ') END AS recommendation FROM conversations"
)
def csv_skip_bad(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations")
    good, short = F.concat(F.lit("0, "), _quoted("text"), F.lit(", 'strong', 'high'")), F.concat(F.lit("0, "), _quoted("text"), F.lit(", 'b'"))
    answer = F.when(F.col("role") == "user", good).when(F.col("role") == "system", short).otherwise(F.concat(good, F.lit("\n1, 'a', 'b', 'c', 'd'")))
    keyed = turns.select(F.concat_ws(":", "conv_id", "turn").alias("key"), answer.alias("answer"))
    found = csv_text.parse_answers(keyed, "key", "answer").select("key", "status", "recommendation")
    k = F.split("key", ":")
    return found.select(k[0].cast("bigint").alias("conv_id"), k[1].cast("bigint").alias("turn"), "status", "recommendation")


@query(
    "SELECT conv_id AS doc, turn AS page, role AS recommendation, 'strong recommendation' AS class, 'high' AS LOE, 'ok' AS status FROM conversations WHERE role <> 'system'"
)
def llm_replay(spark: SparkSession, sf: str) -> DataFrame:
    turns = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("text").alias("page_content"), "role")
    said = F.when(F.col("role") == "system", "NO recommendation found.").otherwise(
        F.concat(F.lit(tables.BOILERPLATE[0] + "0, '"), F.col("role"), F.lit("', 'strong recommendation', 'high'" + tables.BOILERPLATE[3]))
    )
    recorded = extraction.prompts_of(turns).select("prompt", said.alias("response"))
    found = extraction.extract(turns.drop("role"), recorded)
    return found.select("doc", "page", "recommendation", "class", "LOE", "status")


# matching


@query(f"WITH {_DOC_SQL} SELECT row_id FROM exact")
def exact_gate(spark: SparkSession, sf: str) -> DataFrame:
    return match.exact_gate(_ext(spark, sf), _gt(spark, sf)).select("row_id")


@query(f"WITH {_DOC_SQL} SELECT row_id, matched_text, grade_eval, level_eval FROM exact")
def exact_lookup_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.exact_matches(_ext(spark, sf), _gt(spark, sf)).select("row_id", "matched_text", "grade_eval", "level_eval")


@query(f"WITH {_DOC_SQL} SELECT * FROM gt WHERE NOT EXISTS (SELECT 1 FROM ext WHERE ext.recommendation IS NOT DISTINCT FROM gt.recommendation)")
def missing_anti(spark: SparkSession, sf: str) -> DataFrame:
    return match.missing(_gt(spark, sf), _ext(spark, sf))


@query(
    f"WITH {_DOC_SQL} SELECT count(*) * 100.0 / (SELECT count(*) FROM ext) AS accuracy_recommendation, "
    "count(*) FILTER (grade_eval) * 100.0 / count(*) AS accuracy_grade, count(*) FILTER (level_eval) * 100.0 / count(*) AS accuracy_level FROM exact"
)
def eval_metrics_exact(spark: SparkSession, sf: str) -> DataFrame:
    ext = _ext(spark, sf)
    found = match.exact_matches(ext, _gt(spark, sf))
    rest = match.unmatched(ext.join(found.select("row_id"), "row_id", "left_anti"))
    return metrics.accuracies(found.unionByName(rest)).select("accuracy_recommendation", "accuracy_grade", "accuracy_level")


@query(
    "WITH d AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1) "
    "SELECT count(*) AS n_records, count(d.doc_id) AS n_matched, count(*) FILTER (lower(e.lang) = lower(d.lang)) AS n_grade, "
    "count(*) FILTER (lower(e.source) = lower(d.source)) AS n_level FROM documents e LEFT JOIN d ON lower(e.text) = lower(d.text)"
)
def self_eval(spark: SparkSession, sf: str) -> DataFrame:
    gt = _records(_t(spark, sf, "documents"))
    return metrics.accuracies(match.exact_matches(gt, gt)).select("n_records", "n_matched", "n_grade", "n_level")


@query(
    "WITH m AS (SELECT d.doc_id, n.doc_id AS matched FROM documents d LEFT JOIN labels n ON d.doc_id = n.doc_id AND d.doc_id < n.doc_id) "
    "SELECT count(matched) * 100.0 / count(*) AS accuracy_recommendation, coalesce(count(matched) * 100.0 / nullif(count(matched), 0), 0) AS accuracy_grade, "
    "coalesce(count(matched) * 100.0 / nullif(count(matched), 0), 0) AS accuracy_level FROM m"
)
def metrics_zero_guard(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracies(match.unmatched(_records(_t(spark, sf, "documents")))).select("accuracy_recommendation", "accuracy_grade", "accuracy_level")


@query(
    f"WITH {_PART_SQL}, c AS (SELECT DISTINCT lower(recommendation) AS q FROM ext), r AS (SELECT lower(recommendation) AS choice, row_id FROM gt), "
    "p AS (SELECT q, choice, -levenshtein(q, choice) AS score FROM c CROSS JOIN (SELECT DISTINCT choice FROM r)) "
    "SELECT q, row_number() OVER w AS rank, choice, row_id AS gt_row_id, CAST(score AS DOUBLE) AS score FROM p JOIN r USING (choice) "
    "WINDOW w AS (PARTITION BY q ORDER BY score DESC, row_id) QUALIFY row_number() OVER w <= 10"
)
def levenshtein_topk(spark: SparkSession, sf: str) -> DataFrame:
    return match.fuzzy_top(_part_ext(spark, sf), _part_gt(spark, sf), lambda a, b: (F.lit(0) - F.levenshtein(a, b)).cast("double"))


@query(
    f"""WITH {_PART_SQL}, wanted AS (SELECT DISTINCT lower(e.recommendation) AS q, f.k FROM ext e, firstl f), {_WEIGHTED_SQL},
    r AS (SELECT lower(recommendation) AS choice, row_id FROM gt)
    SELECT q, row_number() OVER w AS rank, choice, row_id AS gt_row_id, round_even(score, 0) AS score FROM weighted JOIN r ON k = choice
    WINDOW w AS (PARTITION BY q ORDER BY weighted.score DESC, row_id) QUALIFY row_number() OVER w <= 10"""
)
def wratio_topk(spark: SparkSession, sf: str) -> DataFrame:
    return match.fuzzy_top(_part_ext(spark, sf), _part_gt(spark, sf))


_FUZZY_SQL = f"""WITH {_PART_SQL}, wanted AS (SELECT DISTINCT lower(e.recommendation) AS q, f.k FROM ext e, firstl f), {_WEIGHTED_SQL},
    best AS (SELECT q, k, class, LOE, score FROM weighted JOIN firstl USING (k) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) = 1)
    SELECT e.row_id, e.recommendation AS recommendation_text, e.class AS recommendation_grade, e.LOE AS recommendation_level, b.k AS matched_text,
           lower(e.class) = lower(b.class) AS grade_eval, lower(e.LOE) = lower(b.LOE) AS level_eval, round_even(score, 0) AS match_score,
           false AS manual_validation, 'fuzzy' AS match_stage
    FROM ext e JOIN best b ON lower(e.recommendation) = b.q WHERE round_even(score, 0) >= 95"""


@query(_FUZZY_SQL)
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of distinct texts, scored."""
    return match.fuzzy_matches(_part_ext(spark, sf), _part_gt(spark, sf), lambda a, b: fuzzy.weighted_ratio(a, b))


@query(_FUZZY_SQL)
def fuzzy_match_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return match.blocked_fuzzy_matches(_part_ext(spark, sf), _part_gt(spark, sf))


@query(
    f"WITH {_PART_SQL}, k AS (SELECT DISTINCT lower(recommendation) AS g, array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(recommendation), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')), ' '), lambda x: x <> '')), ' ') AS s FROM gt), "
    "e AS (SELECT row_id, array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(recommendation), '[^\\p{L}\\p{N}]', ' ', 'g')), ' '), lambda x: x <> '')), ' ') AS s FROM ext) "
    "SELECT e.row_id, k.g AS choice FROM e JOIN k USING (s)"
)
def token_sort_join(spark: SparkSession, sf: str) -> DataFrame:
    right = _part_gt(spark, sf).select(F.lower("recommendation").alias("choice")).distinct().withColumn("s", fuzzy.token_sort_expr(F.col("choice")))
    return _part_ext(spark, sf).withColumn("s", fuzzy.token_sort_expr(F.col("recommendation"))).join(right, "s").select("row_id", "choice")


_COSINE = (
    "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS best_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim "
    "FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
    "m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, best_id) = 1) "
    "SELECT query_id, best_id, round(sim, 6) AS sim FROM m"
)


def _argmax(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return match.nearest_vectors(v, v).withColumn("sim", F.round("sim", 6))


@query(_COSINE)
def cosine_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _argmax(spark, sf)


@query(_COSINE + " WHERE round(sim, 6) >= 0.35")
def semantic_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _argmax(spark, sf).where("sim >= 0.35")


@query(f"WITH {_PART_SQL} SELECT * FROM matches")
def cascade_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.cascade(_part_ext(spark, sf), _part_gt(spark, sf), fuzzy.edit_ratio, fuzzy.token_jaccard).select(*_MATCH)


@query(
    f"WITH {_PART_SQL} SELECT count(*) FILTER (match_stage <> 'none') * 100.0 / count(*) AS accuracy_recommendation, "
    "count(*) FILTER (grade_eval) * 100.0 / count(*) FILTER (match_stage <> 'none') AS accuracy_grade, "
    "count(*) FILTER (level_eval) * 100.0 / count(*) FILTER (match_stage <> 'none') AS accuracy_level, "
    "(SELECT count(*) FROM gt WHERE NOT EXISTS (SELECT 1 FROM ext WHERE ext.recommendation = gt.recommendation)) AS n_missing_recommendations FROM matches"
)
def cascade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate_extraction(_part_ext(spark, sf), _part_gt(spark, sf), fuzzy.token_jaccard, fuzzy=fuzzy.edit_ratio).metrics


@query(
    f"""WITH {_PART_SQL}, r AS (SELECT lower(recommendation) AS choice, row_id FROM gt),
    p AS (SELECT q, choice, round(100.0 * (1.0 - levenshtein(q, choice) / greatest(length(q), length(choice), 1)), 6) AS score
          FROM (SELECT DISTINCT lower(recommendation) AS q FROM left2) CROSS JOIN (SELECT DISTINCT choice FROM r)),
    c AS (SELECT q, row_number() OVER w AS rank, choice, round_even(score, 0) AS score FROM p JOIN r USING (choice)
          WINDOW w AS (PARTITION BY q ORDER BY score DESC, row_id) QUALIFY row_number() OVER w <= 10)
    SELECT row_id, NULL AS matched_text, NULL AS grade_eval, NULL AS level_eval, NULL AS match_score, true AS manual_validation FROM left2 WHERE row_id % 12 = 10
    UNION ALL
    SELECT l.row_id, c.choice AS matched_text, lower(l.class) = lower(f.class) AS grade_eval, lower(l.LOE) = lower(f.LOE) AS level_eval,
           c.score AS match_score, true AS manual_validation
    FROM left2 l JOIN c ON lower(l.recommendation) = c.q AND c.rank = l.row_id % 12 + 1 JOIN firstl f ON c.choice = f.k"""
)
def adjudicated_match(spark: SparkSession, sf: str) -> DataFrame:
    ext, gt = _part_ext(spark, sf), _part_gt(spark, sf)
    chosen = ext.select("row_id", (F.col("row_id") % 12).cast("string").alias("choice"))  # 10 is none of them, 11 is invalid
    found = match.cascade(ext, gt, fuzzy.edit_ratio, None, chosen).where("manual_validation")
    return found.select("row_id", "matched_text", "grade_eval", "level_eval", "match_score", "manual_validation")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_contains(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = _t(spark, sf, "documents").select("doc_id", "text"), _t(spark, sf, "benchmark")
    return match.containing(docs, "doc_id", "text", items, "item_id", "text")


@query(
    f"""WITH {_PART_SQL}, m AS (
      SELECT count(*) FILTER (match_stage <> 'none') * 100.0 / count(*) AS r, count(*) FILTER (grade_eval) * 100.0 / count(*) FILTER (match_stage <> 'none') AS g,
             count(*) FILTER (level_eval) * 100.0 / count(*) FILTER (match_stage <> 'none') AS l,
             (SELECT count(*) FROM gt WHERE NOT EXISTS (SELECT 1 FROM ext WHERE ext.recommendation = gt.recommendation)) AS n FROM matches)
    SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS pos, unnest(['Recommendation accuracy: ' || printf('%.2f', r) || '%', 'Grade accuracy: ' || printf('%.2f', g) || '%',
           'Level accuracy: ' || printf('%.2f', l) || '%', 'Missing recommendations: ' || n]) AS line FROM m"""
)
def console_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate_extraction(_part_ext(spark, sf), _part_gt(spark, sf), fuzzy.token_jaccard, fuzzy=fuzzy.edit_ratio)
    return sinks.metric_lines(found.metrics)


# models

_SCORES = """scores AS (
    SELECT x.model, x.pred, CAST(quality * 3 + toxic AS DOUBLE) AS score FROM (
      SELECT quality, toxic, unnest([{'model': 'n_chars', 'pred': n_chars::DOUBLE}, {'model': 'n_bytes', 'pred': strlen(text)::DOUBLE},
                                     {'model': 'toxic', 'pred': (1 - toxic)::DOUBLE}]) AS x
      FROM labels JOIN documents USING (doc_id))),
    g AS (SELECT model, pred, count(*) FILTER (score >= 3) AS pos, count(*) FILTER (score < 3) AS neg FROM scores GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
          FROM g WINDOW w AS (PARTITION BY model ORDER BY pred DESC)),
    points AS (SELECT model, pred AS threshold, fp::DOUBLE / n::DOUBLE AS fpr, tp::DOUBLE / p::DOUBLE AS tpr FROM c
               UNION ALL SELECT DISTINCT model, 'infinity'::DOUBLE, 0.0, 0.0 FROM c),
    youden AS (SELECT model, threshold AS youden_index FROM points
               QUALIFY row_number() OVER (PARTITION BY model ORDER BY tpr - fpr DESC, threshold DESC) = 1),
    auc AS (SELECT model, round(sum(pos * (n - fp + neg / 2.0))::DOUBLE / max(p * n)::DOUBLE, 6) AS auc FROM c GROUP BY model),
    pearson AS (SELECT model, round(corr(pred, score), 6) AS pearson_correlation FROM scores GROUP BY model)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    joined = _t(spark, sf, "labels").join(_t(spark, sf, "documents"), "doc_id")
    pairs = joined.select("doc_id", "n_chars", F.octet_length("text").alias("n_bytes"), (1 - F.col("toxic")).alias("not_toxic"), (F.col("quality") * 3 + F.col("toxic")).alias("s"))
    return melt(pairs, {"n_chars": "n_chars", "n_bytes": "n_bytes", "toxic": "not_toxic"}, "s", "doc_id")


@query(f"WITH {_SCORES} SELECT * FROM pearson")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return roc.pearson(_scored(spark, sf)).withColumn("pearson_correlation", F.round("pearson_correlation", 6))


@query(f"WITH {_SCORES} SELECT * FROM auc")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return roc.auc_of(roc.counts(_scored(spark, sf))).withColumn("auc", F.round("auc", 6))


@query(f"WITH {_SCORES} SELECT model, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM points")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    points = roc.points_of(roc.counts(_scored(spark, sf)))
    return points.withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


@query(f"WITH {_SCORES} SELECT * FROM youden")
def youden_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return roc.youden_of(roc.points_of(roc.counts(_scored(spark, sf))))


@query(f"WITH {_SCORES} SELECT model, pearson_correlation, auc, youden_index, false AS retrained FROM pearson JOIN auc USING (model) JOIN youden USING (model)")
def model_results(spark: SparkSession, sf: str) -> DataFrame:
    return roc.evaluate(_scored(spark, sf)).withColumns({c: F.round(c, 6) for c in ("pearson_correlation", "auc")})


@query(
    "WITH p AS (SELECT p_partkey AS row_id, p_name AS a, p_type || ' ' || p_name AS b, (p_size % 6)::DOUBLE AS score FROM part), scores AS ("
    " SELECT x.model, x.pred, score FROM (SELECT score, unnest(["
    "  {'model': 'edit_ratio', 'pred': round(100.0 * (1.0 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b), 1)), 6)},"
    "  {'model': 'token_jaccard', 'pred': round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))), 6)}"
    f" ]) AS x FROM p)){_SCORES[_SCORES.index(',' + chr(10) + '    g AS'):]} "
    "SELECT model, pearson_correlation, auc, youden_index, false AS retrained FROM pearson JOIN auc USING (model) JOIN youden USING (model)"
)
def model_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _t(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("sentence1"), F.concat_ws(" ", "p_type", "p_name").alias("sentence2"), (F.col("p_size") % 6).cast("double").alias("score")
    )
    found, _ = evaluate_models(pairs, NATIVE[:2])
    return found.withColumns({c: F.round(c, 6) for c in ("pearson_correlation", "auc")})


@query("SELECT doc_id AS row_id, n_chars::DOUBLE AS n_chars, strlen(text)::DOUBLE AS n_bytes, (1 - toxic)::DOUBLE AS toxic FROM labels JOIN documents USING (doc_id)")
def scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide(_scored(spark, sf), ["n_chars", "n_bytes", "toxic"])


@query(
    "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id + 42 AS HUGEINT) % 4294967296 * 2654435761 % 4294967296, doc_id) AS k, count(*) OVER () AS n FROM documents) "
    "SELECT doc_id, CASE WHEN k <= ceil(ceil(round(n * 0.3, 9)) * 0.5) THEN 'test' WHEN k <= ceil(round(n * 0.3, 9)) THEN 'val' ELSE 'train' END AS split FROM o"
)
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_exact(_t(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id + 42 AS HUGEINT) % 4294967296 * 2654435761 % 4294967296, doc_id) AS k, count(*) OVER () AS n FROM documents) "
    "SELECT doc_id, k - 1 AS row_id FROM o WHERE k <= round_even(n * 0.01, 0)"
)
def sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_exact(_t(spark, sf, "documents").select("doc_id"), "doc_id", 0.01)
