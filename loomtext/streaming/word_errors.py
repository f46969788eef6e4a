"""Word error rates over a stream: distances and lengths add up, so a running sum is exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..operators.word_errors import corpus_rate, pair_errors


def running_rate(pairs: DataFrame, *by: str, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """For a streaming DataFrame of hyp and ref; write it in complete or update mode. Before the first
    reference token the rate is null."""
    return corpus_rate(pair_errors(pairs, tokenize), *by, lenient=True)
