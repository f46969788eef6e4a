"""Batches of arrays: numbering, padding, masks, and the preparation of audio samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder


def in_batches(df: DataFrame, order: str, size: int = 8, place: str | None = None) -> DataFrame:
    """``df`` with ``batch_id`` and, if named, the ``place`` in the batch: rows in order, ``size`` to a batch.

    Rows are range-partitioned by the order, sorted, and written with the number of their partition and their
    place in it. Where a partition begins follows from the (few) counts of those before, read from the same
    table: no step numbers partitions anew, so neither adaptive execution nor a stage that runs again
    moves a row. Rows of equal ``order`` stand in some order that is written too. Nulls come first.
    """
    spark = df.sparkSession
    # the upper bits are the partition, the lower 33 the row in it
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(F.col(order)).withColumn("__at", at)
    path = fresh_folder(spark)
    ranged.write.parquet(path)
    written = spark.read.schema(ranged.schema).parquet(path)
    part = F.shiftright("__at", 33)
    counts = written.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = counts.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = written.join(before, part == F.col("__of"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = out.withColumn("batch_id", F.floor(number / size))
    out = out if place is None else out.withColumn(place, (number % size).cast("int"))
    return out.drop("__at", "__of", "__before")


def padded(df: DataFrame, column: str, batch: str = "batch_id") -> DataFrame:
    """Arrays filled with 0 to the longest of their batch, and ``padding_mask``, true where filled."""
    widest = F.max(F.size(column)).over(Window.partitionBy(batch))
    out = df.withColumn("__size", F.size(column)).withColumn("__max", widest)
    mask = F.transform(F.sequence(F.lit(0), F.greatest(F.col("__max") - 1, F.lit(0))), lambda i: i >= F.col("__size"))
    fill = F.concat(F.col(column), F.array_repeat(F.lit(0.0), F.col("__max") - F.col("__size")))
    return out.withColumn("padding_mask", F.when(F.col("__max") > 0, mask).otherwise(F.array().cast("array<boolean>"))).withColumn(column, fill).drop("__size", "__max")


def first_channel(samples: Column) -> Column:
    """Of frames with several channels, the first."""
    return F.transform(samples, lambda x: F.get(x, 0))


def at_least(samples: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(samples, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(samples), F.lit(0))))


def at_most(samples: Column, length: int) -> Column:
    return F.slice(samples, 1, length)


def prepared(samples: Column, rate: Column | int, target_rate: int = 16_000, seconds: int = 30) -> Column:
    """Zeros up to one second at the original rate, then the first ``seconds`` at the target rate. Resampling is the caller's."""
    return at_most(at_least(samples, rate), target_rate * seconds)


def repeated_id(value: int) -> Column:
    return F.array_repeat(F.lit(value), 1)


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1
