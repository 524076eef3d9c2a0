"""Text similarity in Arrow batches: the engine has no longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def lcs(a: str, b: str) -> int:
    """Length of a longest common subsequence: one addition and a few bit operations over a row of bits as long as `a` for
    each character of `b`; a bit that falls marks a longer subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


@pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], int] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (n := known.get((x, y))) is None:
            n = known[x, y] = len(x) if x == y else lcs(x, y)
        out.append(n)
    return pd.Series(out, dtype="Int32")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of a longest common subsequence of characters; null where a text is."""
    return _lcs(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised insertion-deletion similarity, 2 LCS / (|a| + |b|); 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs_length(a, b) / total)
