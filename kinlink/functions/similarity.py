"""Similarities of strings and sets. Levenshtein, Jaccard and Jaro-Winkler (from Jaro) are Catalyst expressions; Jaro
itself has no built-in and runs in Arrow batches."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def lev_sim(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct elements; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


@lru_cache(maxsize=200_000)
def jaro_of(a: str, b: str) -> float:
    """Jaro similarity by code points; 1 for two empty strings, 0 if one is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    taken, left = bytearray(len(b)), []
    start = dict.fromkeys(places, 0)
    for i, c in enumerate(a):
        at = places.get(c)
        if not at:
            continue
        k = start[c]
        while k < len(at) and at[k] < i - reach:  # out of reach for all later places too
            k += 1
        start[c] = k
        if k < len(at) and at[k] <= i + reach:
            taken[at[k]] = 1
            start[c] = k + 1
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, (j for j in range(len(b)) if taken[j]))) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro(a: Column, b: Column) -> Column:
    """Equal and empty strings are settled in the JVM; Python sees only the others."""
    import pandas as pd

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_of(p, q) for p, q in zip(x, y)], dtype="float64")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    settled = F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0))
    open_ = (a != b) & (a != "") & (b != "")
    return F.coalesce(settled, F.pandas_udf(run, "double")(F.when(open_, a), F.when(open_, b)))


def jaro_winkler(a: Column, b: Column, j: Column) -> Column:
    """From the Jaro similarity j: above 0.7 a common prefix of up to 4 characters adds a tenth of the rest for each."""
    prefix = F.lit(0)
    for n in (1, 2, 3, 4):
        same = (F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.length(a) >= n) & (F.length(b) >= n)
        prefix = F.when(same, n).otherwise(prefix)
    return F.when(j > 0.7, j + prefix * 0.1 * (1 - j)).otherwise(j)
