"""Pages to records through a language model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.csv_text import parse_answers
from marlstone.functions.text import extraction_prompt, is_empty_answer, strip_literals, strip_reasoning, task_prompt
from marlstone.sources.pages import complete, replay


def prompts_of(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, page_content) with prompt."""
    return pages.withColumn("prompt", extraction_prompt(F.col("page_content")))


def clean_answers(answers: DataFrame, reasoning: bool = False) -> DataFrame:
    """Answers that found something, as answer, without what models put around CSV."""
    kept = answers.where(~is_empty_answer(F.col("response")))
    text = strip_reasoning(F.col("response")) if reasoning else F.col("response")
    return kept.withColumn("answer", strip_literals(text))


def extract(pages: DataFrame, client: Callable[[str], str] | DataFrame, reasoning: bool = False) -> DataFrame:
    """doc, page, status, row_no and the record, of all pages together.

    client is called once for each page, or is a table of recorded completions. An
    answer that is no CSV is one row with its status, so no page is lost unseen.
    """
    asked = prompts_of(pages)
    answered = replay(asked, client) if isinstance(client, DataFrame) else complete(asked, client)
    cleaned = clean_answers(answered, reasoning).withColumn("k", F.struct("doc", "page"))
    keyed = cleaned.select(F.to_json("k").alias("key"), "doc", "page", "answer")
    rows = parse_answers(keyed, "key", "answer")
    return rows.join(keyed.select("key", "doc", "page"), "key").drop("key")


def ask_fields(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each document with each task: doc, task, prompt."""
    both = documents.crossJoin(tasks.select("task"))
    return both.select("doc", "task", task_prompt(F.col("page_content"), F.col("task")).alias("prompt"))
