"""Quality rules: fixed counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed n-grams (words and pairs of neighbouring words, in ``BUCKETS`` cells)
are counted, one over the trusted documents and one over the whole corpus. A document's score is the
mean over its n-grams of log(p trusted / p corpus); documents below a fixed threshold go. Nothing is
drawn at random.

Scale: the counts are summed within tasks before the one small shuffle (``BUCKETS`` rows from each);
the ratios, 8 * BUCKETS bytes at any input, go out as a literal. Scoring and the counts of repeated
words stay within a row, so no document is exploded into the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, need

_CELL = 14
BUCKETS = 1 << _CELL
#: Trusted documents that the target multinomial is fitted on, at most: those of least hashed id.
TRUSTED = 20_000
#: Mean log ratio, in nats a feature, below which a document isn't kept.
THRESHOLD = -0.08
SMOOTHING = 0.5
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``; of null an empty array. Plain replacements and a plain
    split take a fraction of a regular expression's time."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def _cells(name: str, i: str) -> tuple[str, str]:
    """SQL for the cells of the word at ``i`` of the array ``name`` and of the pair that it ends."""
    before = f"if({i} = 0, '\\n', get({name}, {i} - 1))"
    return f"cast(xxhash64(get({name}, {i})) & {BUCKETS - 1} as int)", f"cast(xxhash64({before}, get({name}, {i})) & {BUCKETS - 1} as int)"


def held(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with these columns worked out once a row.

    They pass through a generator of one row, which the optimizer doesn't see through: without it a
    filter on one of them is pushed below, and the arrays are worked out anew for each element.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*columns))))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (its text and the array ``__words``) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    c = F.coalesce(F.col(text), F.lit(""))
    plain = c
    for x in SYMBOLS:
        plain = F.replace(plain, F.lit(x), F.lit(""))
    lines = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        df.withColumn("__lines", lines)
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(c) - F.length(plain)).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__lines")
    )
    return with_repeats(out, "__words", "n_repeat_words")


def with_repeats(df: DataFrame, name: str, into: str) -> DataFrame:
    """``df`` with the number of words that windows of three cover which stand twice or more in the array ``name``.

    Windows are sorted by their 64-bit hash, then place; so equal windows stand side by side, and
    where the hashes agree the words themselves are compared. The covered words follow from the
    places of such windows.
    """
    window = f"xxhash64(get({name}, i), get({name}, i + 1), get({name}, i + 2))"
    keys = f"if(size({name}) < 4, cast(array() as array<struct<h:bigint,p:int>>), transform(sequence(0, size({name}) - 3), i -> struct({window} as h, cast(i as int) as p)))"
    out = df.withColumn("__sorted", F.expr(f"sort_array({keys})"))
    alike = "filter(sequence(1, size(__sorted) - 1), j -> __sorted[j].h = __sorted[j - 1].h)"
    out = out.withColumn("__alike", F.expr(f"if(size(__sorted) < 2, cast(array() as array<int>), {alike})"))
    same = " and ".join(f"{name}[x[0] + {o}] = {name}[x[1] + {o}]" for o in range(3))
    pairs = f"filter(transform(__alike, j -> array(__sorted[j - 1].p, __sorted[j].p)), x -> {same})"
    out = out.withColumn("__places", F.expr(f"sort_array(array_distinct(flatten({pairs})))"))
    total = "aggregate(__places, named_struct('n', 0L, 'last', -3), (x, p) -> named_struct('n', x.n + least(3, p - x.last), 'last', p), x -> x.n)"
    return out.withColumn(into, F.expr(total)).drop("__sorted", "__alike", "__places")


def log_ratios(corpus: DataFrame) -> list[float]:
    """log(p trusted / p corpus) of each cell, from (text, trusted) of every document.

    Both multinomials are smoothed alike; without trusted features all ratios are 0.
    """
    each = held(corpus.select("trusted", "text"), words(F.col("text")).alias("w")).where("size(w) > 0")
    each = each.select("trusted", F.expr(f"explode(flatten(transform(sequence(0, size(w) - 1), i -> array({', '.join(_cells('w', 'i'))})))) as cell"))
    rows = each.groupBy("cell").agg(F.count("*").alias("every"), F.sum(F.col("trusted").cast("long")).alias("good")).collect()  # BUCKETS rows at most
    every, good = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in rows:
        every[r["cell"]] += r["every"]
        good[r["cell"]] += r["good"]
    if not any(r["good"] for r in rows):
        return [0.0] * BUCKETS
    return [float(x) for x in np.log(good / good.sum()) - np.log(every / every.sum())]


def with_score(df: DataFrame, ratios: list[float]) -> DataFrame:
    """``df`` with ``llr``, the mean log ratio of the n-grams of the array ``__words``; 0 without any."""
    out = df.withColumn("__ratios", F.lit(np.array(ratios, np.float64)))
    one, two = _cells("__words", "i")
    total = F.expr(f"aggregate(sequence(0, size(__words) - 1), 0d, (x, i) -> x + get(__ratios, {one}) + get(__ratios, {two}))")
    mean = F.when(F.size("__words") > 0, total / (2 * F.size("__words"))).otherwise(F.lit(0.0))
    return out.withColumn("llr", mean).drop("__ratios")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]


def judge(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """``row`` (every column of ``documents``) with the base counts, base_failed, llr and kept.

    The target is fitted on documents that ``labels`` calls quality 1, ``trusted`` of them at most;
    the corpus counts cover every document. A document fails the base with under 50 words or with
    more than half of its words in repeated windows of three. Null texts count as empty and fail;
    null doc_ids are never trusted; a doc_id is trusted when any of its label rows is 1.
    """
    good = need(labels, doc_id="long", quality="int").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = least_hashed(good, trusted).select(F.col("doc_id").alias("__id"))
    corpus = need(documents, doc_id="long", text="string")
    corpus = corpus.join(F.broadcast(good), corpus.doc_id == good["__id"], "left").select("text", F.col("__id").isNotNull().alias("trusted"))
    ratios = log_ratios(corpus)
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    out = out.withColumn("text", F.col("row.text").cast("string"))
    out = held(out, words(F.col("text")).alias("__words"))
    out = with_score(base_counts(out), ratios)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return held(out.select(F.col("row").alias("__row"), *[F.col(c).alias(f"__{c}") for c in COUNTS]), F.col("__row").alias("row"), *[F.col(f"__{c}").alias(c) for c in COUNTS]).select("row", *COUNTS)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, columns unchanged."""
    return judge(documents, labels, threshold).where("kept").select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
