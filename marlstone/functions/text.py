"""Expressions over strings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.schemas import CERTAINTIES, STRENGTHS
from marlstone.sources.tables import BOILERPLATE

NOTHING_FOUND = "no recommendation found"


def is_empty_answer(response: Column) -> Column:
    """Whether a response says, in any case and anywhere, that the page holds nothing."""
    return F.lower(response).contains(NOTHING_FOUND)


def strip_literals(text: Column, literals: Sequence[str] = BOILERPLATE) -> Column:
    """The text without the literals, taken away one after another in their order."""
    return reduce(lambda c, literal: F.replace(c, F.lit(literal), F.lit("")), literals, text)


def strip_reasoning(text: Column) -> Column:
    """The text without a reasoning block; to be asked for, as it is no part of the plain cleaning."""
    return F.regexp_replace(text, "(?s)<think>.*?</think>", "")


PROMPT_HEAD = (
    "List every clinical recommendation of the page below, one on each line, as CSV without a header. "
    "Columns: number from 0, text of the recommendation, its strength, certainty of the evidence. "
    f"Strength is one of: {', '.join(STRENGTHS)}. Certainty is one of: {', '.join(CERTAINTIES)}. "
    "Put strings between single quotes. If there is none, answer only: No recommendation found.\n\nPage:\n"
)


def extraction_prompt(page: Column) -> Column:
    """Asks for the recommendations of a page as quoted CSV lines."""
    return F.concat(F.lit(PROMPT_HEAD), page)


def task_prompt(page: Column, task: Column) -> Column:
    """Asks for one field of a meta-analysis."""
    return F.concat(F.lit("Read the study below and give its "), task, F.lit(" with a confidence of green, yellow or red.\n\nStudy:\n"), page)


def token_estimate(text: Column, factor: int = 3) -> Column:
    """Room that a text may need in a model's context: its characters times a factor."""
    return F.length(text) * F.lit(factor)


def same_folded(a: Column, b: Column) -> Column:
    """Equality in lower case, untrimmed; false if either is null."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def choice_kind(choice: Column, candidates: Column) -> Column:
    """accept for a number below the candidates' number, none for that number, else invalid."""
    number = F.when(choice.rlike("^[0-9]+$"), choice.try_cast("bigint"))
    return F.when(number < candidates, F.lit("accept")).when(number == candidates, F.lit("none")).otherwise(F.lit("invalid"))


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x)
