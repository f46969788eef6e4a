"""A corpus pipeline of five stages; each reads all that the one before kept.

Quality rules, near duplicates by n-gram Jaccard join, exact removal of long repeats, benchmark
decontamination, mixing of sources. Every stage takes (spark, docs, sf_dir); all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, jaccard_join, mixing, quality, substring_dedup
from loomtext.llm.common import Scratch

#: Near duplicates of this pipeline: shingles of five words, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the hashed n-gram ratio.

    Null and empty texts fail and go; equal rows are judged alike; an empty table gives an empty one.
    Columns besides those of ``documents`` stay, whatever their names.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates.

    Texts without words are near to nothing and stay, and so do rows without a doc_id; equal rows are one.
    """
    return jaccard_join.keep_first(docs, SHINGLE, PERCENT)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 13-word windows that an earlier document has; ``n_chars`` follows the text.

    A document of which nothing is left goes; one that had no words before stays as it is. Rows of
    one doc_id aren't earlier than one another, a null doc_id is later than all others.
    """
    found = substring_dedup.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    own = {f.name: F.when(changed, new[f.name.lower()].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`")) for f in docs.schema if f.name.lower() in new}
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth a twentieth of their words; texts without words stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it: size, source_size, target and taken.

    Texts without words have size 0 and nothing is taken of them; null is a source like others. A
    column that has one of these names already is kept as ``input_<name>``.
    """
    names = ("size", "source_size", "target", "taken")
    taken = {c.lower() for c in docs.columns} | set(names)
    kept = []
    for c in docs.columns:
        name = c
        if c.lower() in names:
            name = f"input_{c}"
            while name.lower() in taken:
                name = f"input_{name}"
            taken.add(name.lower())
        kept.append(F.col(f"row.`{c}`").alias(name))
    return mixing.mix(docs).select(*kept, *names)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", long_repeats),
    ("benchmark decontamination", benchmark_passages),
    ("source mix", source_mix),
]

#: SQL can't express the stages' hashes; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(f"stage{k}", docs)
    return docs
