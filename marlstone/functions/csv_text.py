"""CSV that a model wrote into its answer, one answer at a time."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.schemas import PARSED
from marlstone.sources.tables import NA_TOKENS

PARSED_ROWS = "id string, recommendation string, class string, LOE string"
_FIELDS = len(PARSED.fields)


def _open_quote(text: str, quote: str) -> bool:
    """Whether a quoted cell never ends: a quote opens at the start of a cell and has no partner."""
    inside, start, k = False, True, 0
    while k < len(text):
        c = text[k]
        if inside:
            if c == quote:
                if text[k + 1 : k + 2] == quote:
                    k += 1
                else:
                    inside = False
        elif c == quote and start:
            inside, start = True, False
        elif c in ",\n\r":
            start = True
        elif c != " ":
            start = False
        k += 1
    return inside


def parse_answer(text: str | None, quote: str = "'") -> tuple[str, list[list[str | None]]]:
    """Status and rows of an answer.

    ok; empty (nothing to parse); malformed (a row longer than the first, or a quote that
    never closes: the whole answer is skipped); arity (the first row hasn't four
    cells). Shorter rows are filled with nulls, cells that stand for missing are null.
    """
    if text is None or not text.strip():
        return "empty", []
    if _open_quote(text, quote):
        return "malformed", []
    rows = [r for r in csv.reader(io.StringIO(text), quotechar=quote, skipinitialspace=True) if r]
    if not rows:
        return "empty", []
    width = len(rows[0])
    if any(len(r) > width for r in rows):
        return "malformed", []
    if width != _FIELDS:
        return "arity", []
    return "ok", [[None if c in NA_TOKENS else c for c in r] + [None] * (width - len(r)) for r in rows]


def parse_answers(answers: DataFrame, key: str, text: str, quote: str = "'") -> DataFrame:
    """key, status, row_no and the four cells: a row for each parsed row, or one with the status alone."""
    kind = answers.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, answer in zip(batch["k"], batch["t"], strict=True):
                status, rows = parse_answer(answer, quote)
                out += [(k, status, n, *row) for n, row in enumerate(rows)] or [(k, status, None, None, None, None, None)]
            yield pd.DataFrame(out, columns=["k", "status", "row_no", "id", "recommendation", "class", "LOE"]).astype({"row_no": "Int32"})

    source = answers.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInPandas(run, f"k {kind}, status string, row_no int, {PARSED_ROWS}").withColumnRenamed("k", key)


def from_csv_lines(lines: DataFrame, key: str, text: str, quote: str = "'") -> DataFrame:
    """parse_answers for answers without line breaks in cells, JVM-side: key and the four cells.

    An answer with a line of too many cells is left out whole.
    """
    options = {"quote": quote, "escape": quote, "ignoreLeadingWhiteSpace": "true", "columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    line = F.posexplode(F.split(text, "\n", -1)).alias("row_no", "line")
    rows = lines.select(F.col(key), line).where("trim(line) <> ''")
    cells = rows.withColumn("c", F.from_csv("line", f"{PARSED_ROWS}, x string, bad string", options))
    cells = cells.withColumn("over", F.max(F.col("c.x").isNotNull()).over(_by(key)))
    return cells.where(~F.col("over")).select(key, "row_no", "c.id", "c.recommendation", "c.class", "c.LOE")


def _by(key: str):  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.partitionBy(key)
