"""Unit-cost edit distance of two arrays of tokens.

Each distinct token of a pair becomes one character and the built-in ``levenshtein`` does the rest,
inside the JVM. Pairs of more than ``NATIVE`` tokens, for which looking up the numbers would cost
more than the distance, go to Arrow batches, where a column of the table is two bit vectors: one bit
a token, and a few operations on whole vectors a token of the other text. Others reach it as NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.numbers import let

NATIVE = 600
_FIRST = 256


def by_bits(a: Sequence[str], b: Sequence[str]) -> int:
    """The distance from differences of neighbouring cells: a bit of ``up`` and ``down`` says that a cell of the current
    column is one more or one less than the cell above it. Integers of any length are the vectors, so a
    pair of n and m tokens takes m times n / 30 steps of the machine."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for k, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << k
    every, last = (1 << len(b)) - 1, len(b) - 1
    up, down, score = every, 0, len(b)
    for t in a:
        same = where.get(t, 0)
        level = (((same & up) + up) ^ up) | same | down  # the cell is that on its upper left
        right_up = down | (every & ~(level | up))
        right_down = up & level
        score += (right_up >> last & 1) - (right_down >> last & 1)
        right_up = (right_up << 1 | 1) & every
        right_down = right_down << 1 & every
        up = right_down | (every & ~(same | down | right_up))
        down = right_up & (same | down)
    return score


@F.pandas_udf(IntegerType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else by_bits(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _encoded(tokens: Column, known: Column) -> Column:
    code = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + _FIRST), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(tokens, code), "")


def token_distance(a: Column, b: Column) -> Column:
    """The distance; null if either is null."""
    both = F.struct(a.alias("a"), b.alias("b"))
    short = lambda x: F.size(x["a"]) + F.size(x["b"]) <= NATIVE
    known = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_distinct(F.concat(x["a"], x["b"])).alias("known"))
    distance = lambda x: F.levenshtein(_encoded(x["a"], x["known"]), _encoded(x["b"], x["known"]))
    native = let(both, lambda x: F.when(short(x), let(known(x), distance)))
    long_ = F.size(a) + F.size(b) > NATIVE
    return F.coalesce(native, _long_distance(F.when(long_, a), F.when(long_, b)))
