"""One score for each task: error rates of transcripts, consensus of captions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import consensus, word_errors

# The tasks that are scored and the names of their scores.
METRICS = {"asr": "WER", "aac": "SPIDEr"}


def task_scores(samples: DataFrame, tokenize: Callable[[Column], Column] | None = None, skip: bool = False) -> DataFrame:
    """(task, metric, score) of the samples (id, task, hyp, ref); a row for each known task that has any.

    Transcripts are scored by their corpus error rate, of normalized texts unless ``tokenize`` is given,
    captions by their consensus times 100, to 4 places. Other tasks and a null task aren't scored; ``skip``
    gives no rows and reads nothing.
    """
    spark = samples.sparkSession
    scores = spark.createDataFrame([], "task string, metric string, score double")
    if skip:
        return scores
    pairs = samples.select("id", "task", "hyp", "ref")
    met = {r["task"] for r in pairs.where(F.col("task").isin(list(METRICS))).select("task").distinct().collect()}  # two rows at most
    for task in [t for t in METRICS if t in met]:
        own = pairs.where(F.col("task") == task).drop("task")
        if task == "asr":
            score = word_errors.corpus_rate(word_errors.pair_errors(own, tokenize)).select(F.col("wer").alias("score"))
        else:
            score = consensus.spider(own).select(F.col("spider").alias("score"))
        scores = scores.unionByName(score.select(F.lit(task).alias("task"), F.lit(METRICS[task]).alias("metric"), F.col("score").cast("double").alias("score")))
    return scores
