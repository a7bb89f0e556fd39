"""The SQL versions against the operators where rows are harder than in the driver's tables."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from marlstone.llm import decontaminate, licenses, line_dedup, queries


@pytest.fixture
def tables():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    items = []
    for k in range(14):
        sentences = [" ".join(rng.choices(words, k=rng.randint(1, 30))) + rng.choice([".", "?", "!"]) for _ in range(rng.randint(1, 9))]
        items.append((k, rng.choice([" ", "\n"]).join(sentences)))
    items += [(14, ""), (15, None), (16, "...")]
    docs = []
    for k in range(160):
        filler = rng.choices(words, k=rng.randint(0, 300))
        leak = (rng.choice(items[:14])[1]).split(" ")
        kept = [w for w in leak if rng.random() > rng.choice([0, 0, 0.05, 0.15, 0.4])]
        at = rng.randint(0, len(filler))
        lines = [*filler[:at], *kept, *filler[at:], *rng.choice([[], ["\nReleased", "under", "the", "MIT", "License."], ["\n" + " ".join(words[:5])]])]
        docs.append((k, " ".join(lines)))
    docs += [(160, ""), (161, None), (162, " \n \n"), (163, "a\na\nb\n\nb")]
    return docs, items


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_decontamination", "op10_line_dedup"])
def test_sql_gives_the_same_rows(spark, tables, name):
    docs, items = tables
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    made = {"op4_license_scan": lambda: licenses.scan(d), "op5_decontamination": lambda: decontaminate.leaks(d, b), "op10_line_dedup": lambda: line_dedup.maintained(d, "doc_id % 2 <> 0", "doc_id % 4 = 0")}[name]()
    found = Counter(tuple(r[c] for c in sorted(made.columns)) for r in made.collect())
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    db.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    result = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = Counter(tuple(r[columns.index(c)] for c in sorted(columns)) for r in result.fetchall())
    assert sorted(columns) == sorted(made.columns)
    assert found == want
    if name == "op5_decontamination":
        assert len({r[4] for r in want}) > 5  # leaks that are not whole, too
