"""Weighted ratio of two strings, 0 to 100.

Strings are compared in lower case with all but letters and digits as spaces. The plain
ratio is 2 * LCS / (lengths), with the longest common subsequence by bit-parallel
steps on big integers. For strings of like length the result is the best of the ratio
and 0.95 of the ratios of sorted tokens and of token sets; for others, of the ratio
and of scaled ratios of the best substring.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W_]")


def normalise(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def lcs(a: str, b: str) -> int:
    """Length of a longest common subsequence: a bit for each character of a, a step for each of b."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one, windows over the edges too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n, best, here = len(a), 0.0, set(a)
    for start in range(1 - n, len(b)):
        low, high = max(0, start), min(len(b), start + n)
        # a best window begins, and ends, with a character of the shorter string
        if b[high - 1] in here and b[low] in here:
            best = max(best, ratio(a, b[low:high]))
    return best


def _sorted(tokens: list[str]) -> str:
    return " ".join(sorted(tokens))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = _sorted(list(x & y)), _sorted(list(x - y)), _sorted(list(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = ratio(with_left, with_right)
    return max(found, ratio(both, with_left), ratio(both, with_right)) if both else found


def partial_token(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    return max(partial(_sorted(x), _sorted(y)), partial(_sorted(list(set(x))), _sorted(list(set(y)))))


def weighted(a: str | None, b: str | None) -> float:
    """The score before it is rounded; 0 if a side is null or has no letter or digit."""
    a, b = normalise(a or ""), normalise(b or "")
    if not a or not b:
        return 0.0
    best = ratio(a, b)
    q = max(len(a), len(b)) / min(len(a), len(b))
    if q < 1.5:
        sort = ratio(_sorted(a.split()), _sorted(b.split()))
        return max(best, 0.95 * max(sort, token_set(a, b)))
    scale = 0.9 if q < 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


def _weighted_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def weighted_ratio(a: Column | str, b: Column | str) -> Column:
    """weighted() as an Arrow UDF."""
    return F.pandas_udf(_weighted_series, "double")(a, b)


def normal_expr(text: Column) -> Column:
    """normalise() as an expression, but for letters that lower case changes in number."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "))


def token_sort_expr(text: Column) -> Column:
    """The sorted tokens of a text: a key on which equal bags of words join."""
    return F.array_join(F.array_sort(F.filter(F.split(normal_expr(text), " "), lambda t: t != "")), " ")


def edit_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edits / longer length) of lower-cased strings, a scorer without Python."""
    a, b = F.lower(a), F.lower(b)
    return F.round(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))), 6)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of distinct blank-separated tokens, a scorer without Python."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6)
