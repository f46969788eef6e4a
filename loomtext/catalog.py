"""Named queries over the test tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audio_queries, score_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in [*text_queries.QUERIES, *score_queries.QUERIES, *audio_queries.QUERIES]}


def oracle_sql() -> dict[str, str]:
    return text_queries.oracles() | score_queries.oracles() | audio_queries.oracles()
