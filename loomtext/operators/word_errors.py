"""Word error rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize, tokens
from .edit_distance import token_distance


def paired(hyps: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """(key, hyp, ref) by key: what lists do by position. A reference without a hypothesis is an error."""
    both = refs.select(key, "ref").join(hyps.select(F.col(key).alias("__key"), "hyp"), F.col(key) == F.col("__key"), "left")
    return both.select(key, F.when(F.col("__key").isNull(), F.raise_error(F.lit("a reference has no hypothesis"))).otherwise(F.col("hyp")).alias("hyp"), "ref")


def pair_errors(pairs: DataFrame, tokenize: Callable[[Column], Column] | None = None, spelling: dict[str, str] | None = None) -> DataFrame:
    """``pairs`` (with hyp and ref) plus ``distance`` and ``ref_length``; of normalized texts unless ``tokenize`` is given."""
    if tokenize:
        out = normalize.once(normalize.once(pairs, tokenize(F.col("hyp")), "__h"), tokenize(F.col("ref")), "__r")
    else:
        out = normalize.with_normalized(normalize.with_normalized(pairs, "hyp", "__h", spelling), "ref", "__r", spelling)
        out = normalize.once(normalize.once(out, tokens.scoring_tokens(F.col("__h")), "__h"), tokens.scoring_tokens(F.col("__r")), "__r")
    return out.withColumn("distance", token_distance(F.col("__r"), F.col("__h"))).withColumn("ref_length", F.size("__r")).drop("__h", "__r")


def corpus_rate(errors: DataFrame, *by: str, lenient: bool = False) -> DataFrame:
    """Summed distances over summed reference lengths, by group if asked. Without reference tokens that
    is a division by zero, an error, or null if ``lenient``."""
    divide = F.try_divide if lenient else lambda a, b: a / b
    return errors.groupBy(*by).agg(F.sum("distance").alias("distance"), F.sum("ref_length").alias("ref_length")).withColumn("wer", divide(F.col("distance"), F.col("ref_length")))


def word_error_rate(pairs: DataFrame, spelling: dict[str, str] | None = None) -> float:
    """The corpus rate as a number."""
    return corpus_rate(pair_errors(pairs, spelling=spelling)).first()["wer"]


def shown(rate: float) -> str:
    return f"WER: {100 * rate:.4f}%"
