"""Summaries of repeated measurements with warm-up."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

GIB = 1024**3


def summary(runs: DataFrame, warmup: int = 10) -> DataFrame:
    """Means of memory (GiB), inference, ttft and tpot over iterations ``it`` from ``warmup`` on; inference is ttft and tpot together."""
    kept = runs.where(F.col("it") >= warmup).withColumn("inference", F.col("ttft") + F.col("tpot"))
    return kept.agg(
        F.avg(F.col("memory") / GIB).alias("memory_gb"), F.avg("inference").alias("inference_s"), F.avg("ttft").alias("ttft_s"), F.avg("tpot").alias("tpot_s")
    )


def running_peak(runs: DataFrame) -> DataFrame:
    """Memory as a peak that is never reset, in order of ``it``; a run is one short sequence."""
    from pyspark.sql import Window

    return runs.withColumn("memory", F.max("memory").over(Window.orderBy("it").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def observed(runs: Iterable[DataFrame], metrics: dict[str, Column], warmup: int = 0) -> DataFrame:
    """Runs each query to its end, one after another, and returns what was seen: it, ``seconds`` and the metrics.

    Metrics are aggregates that Spark works out while the rows pass (an ``Observation``), so measuring reads
    nothing twice and keeps no rows. The first ``warmup`` runs aren't returned. The table has a row a run.
    """
    seen, spark, kinds = [], None, {}
    for it, run in enumerate(runs):
        spark = run.sparkSession
        watch = Observation()
        shown = run.observe(watch, *[c.alias(n) for n, c in metrics.items()])
        kinds = kinds or dict(run.agg(*[c.alias(n) for n, c in metrics.items()]).dtypes)
        began = time.perf_counter()
        shown.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        if it >= warmup:
            seen.append((it, seconds, *(watch.get[n] for n in metrics)))
    if spark is None:
        raise ValueError("there is nothing to run")
    return spark.createDataFrame(seen, "it int, seconds double, " + ", ".join(f"`{n}` {t}" for n, t in kinds.items()))


# What is printed of a summary.
SHOWN = [
    ("Average memory used during inference", "memory_gb", "GB"), ("Average inference time", "inference_s", "seconds"),
    ("Average TTFT", "ttft_s", "seconds"), ("Average TPOT", "tpot_s", "seconds"),
]


def shown(summary_: DataFrame) -> list[str]:
    row = summary_.first()
    return [f"{what}: {row[column]:.4f} {unit}" for what, column, unit in SHOWN]
