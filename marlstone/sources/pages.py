"""Pages and tables out of documents, and completions of a language model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An adapter gives the pages of a file's bytes, or its tables as lists of rows of cells.
Pages = Callable[[bytes], Iterable[str]]
Tables = Callable[[bytes], Iterable[list[list[str]]]]


def page_explode(docs: DataFrame, doc: str, text: str, separator: str = "\n") -> DataFrame:
    """doc, page (from 0) and page_content: one row for each page of each text. A null text has no page."""
    pages = F.posexplode(F.split(F.col(text), re.escape(separator), -1)).alias("page", "page_content")
    return docs.select(F.col(doc).alias("doc"), pages)


def doc_single(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """The pages of each doc in order as one text: doc, page_content, n_pages. Null pages count as empty."""
    rows = F.array_sort(F.collect_list(F.struct("page", F.coalesce("page_content", F.lit("")).alias("c"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["c"]), separator).alias("page_content"), F.count("*").alias("n_pages"))


def read_pages(spark, path: str, loader: Pages, single: bool = False) -> DataFrame:  # noqa: ANN001
    """Pages of binary files, such as PDF, by a loader that the caller brings: doc (path), page, page_content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                pages = list(loader(content))
                yield pd.DataFrame({"doc": [name] * len(pages), "page": range(len(pages)), "page_content": pages})

    pages = files.mapInPandas(load, "doc string, page int, page_content string")
    return doc_single(pages) if single else pages


class _Tables(HTMLParser):
    """Rows of cells of <table>s; a list without a table gives a table of one column."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.stack: list[tuple[str, int]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("table", "ul", "ol"):
            self._close()
            self.stack.append((tag, len(self.tables)))
            self.tables.append([])
        elif self.stack and tag == "tr":
            self._close()
            self.tables[self.stack[-1][1]].append([])
        elif self.stack and tag in ("td", "th", "li"):
            self._close()
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "li"):
            self._close()
        elif tag in ("table", "ul", "ol") and self.stack:
            self._close()
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is None or not self.stack:
            self.cell = None
            return
        kind, at = self.stack[-1]
        text, self.cell = " ".join("".join(self.cell).split()), None
        if kind == "table":
            if not self.tables[at]:
                self.tables[at].append([])
            self.tables[at][-1].append(text)
        else:
            self.tables[at].append([text])


def html_tables_of(html: str) -> list[list[list[str]]]:
    """The tables and lists of a page that have rows."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    parser._close()
    return [t for t in ([r for r in t if r] for t in parser.tables) if t]


def extract_tables(docs: DataFrame, doc: str, content: str, detect: Callable[[str], Iterable[list[list[str]]]] = html_tables_of) -> DataFrame:
    """doc, table_no, row_no and cells: a row for each row of each table that a detector finds. Null pages have none."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, t, r, cells) for d, c in zip(batch["doc"], batch["content"], strict=True) for t, table in enumerate(detect(c)) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["doc", "table_no", "row_no", "cells"])

    source = docs.select(F.col(doc).alias("doc"), F.col(content).alias("content")).where("content is not null")
    return source.mapInPandas(run, f"doc {kind}, table_no int, row_no int, cells array<string>")


def html_items(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, item_no and item: the plain list items of a page, JVM-side. Markup in an item goes; entities stay."""
    found = F.posexplode(F.regexp_extract_all(html, F.lit("(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("item_no", "item")
    return pages.select(F.col(page).alias("page_id"), found).withColumn("item", F.regexp_replace("item", "<[^>]*>", ""))


def complete(prompts: DataFrame, client: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds response, from a client that the caller brings; one call for each row, partitions side by side."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema.fields)}, response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(response=[None if p is None else client(p) for p in batch[prompt]])

    return prompts.mapInPandas(run, schema)


def replay(prompts: DataFrame, recorded: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Adds response from a table (prompt, response) of earlier completions, by the prompt's hash; null where there is none."""
    known = recorded.select(F.sha2("prompt", 256).alias("mst_h"), "response").groupBy("mst_h").agg(F.min("response").alias("response"))
    return prompts.withColumn("mst_h", F.sha2(prompt, 256)).join(known, "mst_h", "left").drop("mst_h")
