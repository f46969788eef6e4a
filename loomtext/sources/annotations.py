"""Annotation files, lookup files, prompts, raw hypotheses, mock samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("testset_id", "path", "task", "text", "Q")])
SCHEMA = T.StructType([T.StructField("annotation", T.ArrayType(ITEM))])
END_SIGN = "<|end_of_text|>"


def with_defaults(items: DataFrame) -> DataFrame:
    """Task asr and an empty question where they are missing."""
    return items.withColumn("task", F.coalesce("task", F.lit("asr"))).withColumn("Q", F.coalesce("Q", F.lit("")))


def read_annotations(spark: SparkSession, path: str, prefix: str = "", with_text: bool = True) -> DataFrame:
    """One row a sample with its position; ``path`` gets the prefix. Without ``with_text`` the ground truth isn't read."""
    raw = spark.read.option("multiLine", True).schema(SCHEMA).json(path)
    items = with_defaults(raw.select(F.posexplode("annotation").alias("position", "a")).select("position", "a.*"))
    items = items.withColumn("path", F.concat_ws("/", F.lit(prefix) if prefix else F.lit(None), "path"))
    return items if with_text else items.drop("text")


def sample_at(items: DataFrame, position: int) -> DataFrame:
    return items.where(F.col("position") == position)


def read_lookup(spark: SparkSession, path: str, key: str = "src", value: str = "dst") -> DataFrame:
    """A JSON object of strings as rows, with their ``position``: of a key that stands there twice the last one counts."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("position", "e")).select("position", F.col("e.key").alias(key), F.col("e.value").alias(value))


def with_audio(items: DataFrame, audio: DataFrame) -> DataFrame:
    """``items`` (position, path, ...) with the columns of decoded ``audio`` (path, samples, ...) by path.

    A file that is missing or couldn't be decoded (null samples) gives the first item's audio; if that can't be
    read either, that is an error where it is needed.
    """
    fields = [c for c in audio.columns if c != "path"]
    decoded = audio.select(F.col("path").alias("__path"), F.struct(*fields).alias("__audio")).where("__audio.samples is not null")
    first = items.where("position = 0").select(F.col("path").alias("__first")).join(decoded, F.col("__first") == F.col("__path")).select(F.col("__audio").alias("__fallback"))
    joined = items.join(decoded, items["path"] == F.col("__path"), "left")
    # one row, joined by a constant
    joined = joined.withColumn("__one", F.lit(1)).join(F.broadcast(first.limit(1).withColumn("__one", F.lit(1))), "__one", "left")
    unread = F.raise_error(F.concat(F.lit("neither this file nor the first one can be read: "), "path")).cast(joined.schema["__audio"].dataType)
    used = F.coalesce("__audio", "__fallback", unread)
    return joined.withColumn("__used", used).select(*items.columns, *[F.col(f"__used.{c}").alias(c) for c in fields])


def hypothesis(decoded: Column, end: str = END_SIGN) -> Column:
    """What stands before the end sign, in lower case."""
    return F.lower(F.substring_index(decoded, end, 1))


def prompted(items: DataFrame, prompts: DataFrame, template: str = "USER: %s\nASSISTANT:") -> DataFrame:
    """``prompt`` by task from (task, prompt); a task without one is an error."""
    table = prompts.select(F.col("task").alias("__task"), F.col("prompt").alias("__prompt"))
    joined = items.join(table, items["task"] == F.col("__task"), "left")
    missing = F.raise_error(F.concat(F.lit("no prompt for task "), F.coalesce("task", F.lit("null")))).cast("string")
    return joined.withColumn("prompt", F.when(F.col("__task").isNull(), missing).otherwise(F.format_string(template, "__prompt"))).drop("__task", "__prompt")


def mock_samples(spark: SparkSession, rate: int = 16_000, seconds: int = 10, count: int = 100, seed: int = 42) -> DataFrame:
    """``count`` rows with one and the same random buffer and fixed fields."""
    import random

    rng = random.Random(seed)
    buffer = [rng.gauss(0, 1) for _ in range(rate * seconds)]
    one = spark.createDataFrame([(buffer,)], "raw_wav array<double>").withColumn("__one", F.lit(1))
    ids = spark.range(count).withColumn("__one", F.lit(1))
    out = ids.join(F.broadcast(one), "__one").drop("__one")
    return out.select("raw_wav", F.lit("test").alias("text"), F.lit("asr").alias("task"), F.lit("").alias("Q"), F.col("id").cast("int").alias("id"))
