"""CIDEr-D: clipped tf-idf cosine of n-grams with a length penalty, relationally.

Grams are exploded with the sample's id; term frequencies, norms and dot products are all grouped by
a key that begins with the id, so frequent grams don't skew them. Only document frequencies are
grouped by gram, with partial aggregation, and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import words

N, SIGMA, SCALE = 4, 6.0, 10.0
#: References of a sample that are counted in one task; a sample with more is dealt to several.
TOGETHER = 64


def gram_counts(texts: DataFrame, keys: list[str], n: int = N, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(keys, n, gram, tf) of every n-gram of the column ``text``, of orders 1 to n."""
    toks = texts.select(*keys, tokenize(F.col("text")).alias("__t"))

    def slices(k: int) -> Column:
        # a sequence to less than its start would count down
        starts = F.when(F.size("__t") >= k, F.sequence(F.lit(0), F.size("__t") - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice("__t", i + 1, F.lit(k)))

    grams = F.flatten(F.array(*[slices(k) for k in range(1, n + 1)]))
    return toks.select(*keys, F.explode_outer(grams).alias("gram")).where("gram is not null").groupBy(*keys, "gram").agg(F.count("*").alias("tf")).withColumn("n", F.size("gram"))


def document_frequencies(refs: DataFrame, n: int = N, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(gram, df): in how many samples any of the references has the gram."""
    return gram_counts(refs, ["id"], n, tokenize).groupBy("gram").agg(F.count("*").alias("df"))


def weights(counts: DataFrame, df: DataFrame | Callable[[Column], Column], samples: int) -> DataFrame:
    """``counts`` with ``w``, tf-idf. ``df`` is a table (gram, df) or says of a gram in how many samples it is; a gram
    that none has counts as one of a single sample."""
    known = counts.withColumn("df", df(F.col("gram"))) if callable(df) else counts.join(df, "gram", "left")
    idf = F.ln(F.lit(float(samples))) - F.ln(F.greatest(F.lit(1.0), F.coalesce(F.col("df").cast("double"), F.lit(0.0))))
    return known.withColumn("w", F.col("tf") * idf).drop("df")


def lengths(texts: DataFrame, keys: list[str], tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """(keys, length): in words, less one, and never below 0."""
    return texts.select(*keys, F.greatest(F.size(tokenize(F.col("text"))) - 1, F.lit(0)).alias("length"))


def checked(samples: int, df: DataFrame | Callable[[Column], Column]) -> None:
    """Fewer than two samples, or frequencies of no gram at all, are errors, as no frequency means anything then; so are
    frequencies in which more documents hold a gram than there are samples."""
    if samples < 2:
        raise ValueError("at least two samples are needed")
    if callable(df):
        return
    most = df.agg(F.max("df")).first()[0]
    if most is None:
        raise ValueError("the references hold no words")
    if most > samples:
        raise ValueError("more documents hold a gram than there are samples")


def scores(cand: DataFrame, ref: DataFrame, cand_length: DataFrame, ref_length: DataFrame, n: int = N, sigma: float = SIGMA, scale: float = SCALE) -> DataFrame:
    """(id, cider_d) from weighted grams of candidates (id, n, gram, w) and references (id, ref_idx, n, gram, w) and their lengths."""
    cand_norm = cand.groupBy("id", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_c"))
    ref_norm = ref.groupBy("id", "ref_idx", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_r"))
    dots = cand.select("id", "gram", "n", F.col("w").alias("wc")).join(ref.select("id", "gram", "ref_idx", F.col("w").alias("wr")), ["id", "gram"])
    dots = dots.groupBy("id", "ref_idx", "n").agg(F.sum(F.least("wc", "wr") * F.col("wr")).alias("dot"))
    both = ref_length.withColumnRenamed("length", "len_r").join(cand_length.withColumnRenamed("length", "len_c"), "id")
    norm = F.col("norm_c") * F.col("norm_r")
    sims = dots.join(cand_norm, ["id", "n"]).join(ref_norm, ["id", "ref_idx", "n"]).join(both, ["id", "ref_idx"])
    sims = sims.withColumn("sim", F.when(norm != 0, F.col("dot") / norm).otherwise(F.col("dot")) * F.exp(-F.pow(F.col("len_c") - F.col("len_r"), F.lit(2)) / (2 * sigma * sigma)))
    total = sims.groupBy("id").agg(F.sum("sim").alias("sim"))
    each = ref_length.groupBy("id").agg(F.count("*").alias("refs"))
    out = cand_length.select("id").join(each, "id").join(total, "id", "left")
    return out.select("id", (scale * F.coalesce("sim", F.lit(0.0)) / n / F.col("refs")).alias("cider_d"))


def sentence_scores(
    candidates: DataFrame, references: DataFrame, n: int = N, sigma: float = SIGMA, scale: float = SCALE,
    tokenize: Callable[[Column], Column] = words, df: DataFrame | Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(id, cider_d) of each candidate (id, text) against its references (id, ref_idx, text).

    ``df`` replaces the document frequencies of the references themselves; see ``checked`` for what is an error.
    """
    samples = references.select("id").distinct().count()
    if df is None:  # its own frequencies are those of as many samples, so one word is all there is to look for
        df = document_frequencies(references, n, tokenize)
        checked(samples, references.where(F.size(tokenize(F.col("text"))) > 0).select(F.lit(1).alias("df")).limit(1))
    else:
        checked(samples, df)
    cand = weights(gram_counts(candidates, ["id"], n, tokenize), df, samples)
    ref = weights(gram_counts(references, ["id", "ref_idx"], n, tokenize), df, samples)
    return scores(cand, ref, lengths(candidates, ["id"], tokenize), lengths(references, ["id", "ref_idx"], tokenize), n, sigma, scale)


def _grams(texts: DataFrame, n: int) -> DataFrame:
    """``texts`` with ``n`` and ``gram`` for ``tokens``: every gram as one text. Blanks and backslashes within a token are
    written differently, so that different grams are different texts."""
    plain = F.transform("tokens", lambda w: F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit(" "), F.lit("\\_")))
    keys = [c for c in texts.columns if c != "tokens"]
    orders = texts.select(*keys, plain.alias("tokens")).select("*", F.explode(F.array(*[F.lit(k) for k in range(1, n + 1)])).alias("n")).where("size(tokens) >= n")
    grams = F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("n") + 1), lambda i: F.array_join(F.slice("tokens", i, F.col("n")), " "))
    return orders.select(*keys, "n", F.explode(grams).alias("gram"))


def sample_scores(samples: DataFrame, many: int, n: int = N, sigma: float = SIGMA, scale: float = SCALE) -> DataFrame:
    """(id, cider_d) of samples (id, hyp, refs) of tokens, ``refs`` an array of them; ``many`` have references.

    Texts are dealt by sample, so grams are counted and a candidate's meet those of its references without a shuffle.
    Only for their frequencies grams are shuffled, each once with its counts, sorted by hash first. A gram of one sample or
    none weighs the same, so only those of more are joined.
    """
    spark = samples.sparkSession
    samples = samples.where(F.size("refs") > 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    starts = F.sequence(F.lit(0), F.size("refs") - 1, F.lit(TOGETHER))
    dealt = samples.select("id", "hyp", "refs", F.explode(starts).alias("at")).select("id", "at", "hyp", F.slice("refs", F.col("at") + 1, F.lit(TOGETHER)).alias("refs")).repartition(parts, "id", "at")
    refs = dealt.select("id", "at", F.posexplode("refs").alias("ref_idx", "tokens")).withColumn("ref_idx", F.col("ref_idx") + F.col("at"))

    frequent = _grams(refs.select("id", "tokens"), n).select("id", "gram").distinct().groupBy(F.xxhash64("gram").alias("h"), "gram").agg(F.count("*").alias("df")).where("df > 1")

    held = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("ref_idx"), F.col("hyp").alias("tokens"))), F.transform("refs", lambda t, i: F.struct((i + F.col("at")).alias("ref_idx"), t.alias("tokens"))))
    texts = dealt.select("id", "at", F.inline(held))
    counts = _grams(texts, n).groupBy("id", "at", "ref_idx", "n", "gram").agg(F.count("*").alias("tf")).withColumn("h", F.xxhash64("gram"))
    same = Window.partitionBy("h", "gram", "id", "at")
    counts = counts.withColumn("cand", F.max(F.when(F.col("ref_idx").isNull(), F.col("tf"))).over(same)).where("ref_idx is not null or at = 0")
    common = F.least("cand", "tf") * F.col("tf")
    counts = counts.select("id", "ref_idx", "n", "h", "gram", (F.col("tf") * F.col("tf")).alias("own"), F.when(F.col("ref_idx").isNotNull() & F.col("cand").isNotNull(), common).otherwise(0).alias("common"))
    idf = F.ln(F.lit(float(many))) - F.ln(F.coalesce(F.col("df").cast("double"), F.lit(1.0)))
    sums = counts.join(frequent, ["h", "gram"], "left").withColumn("idf2", idf * idf).groupBy("id", "ref_idx", "n").agg(F.sqrt(F.sum(F.col("own") * F.col("idf2"))).alias("norm"), F.sum(F.col("common") * F.col("idf2")).alias("dot"))

    # from here on there are a few rows for each text
    norm_c = F.max(F.when(F.col("ref_idx").isNull(), F.col("norm"))).over(Window.partitionBy("id", "n"))
    sums = sums.withColumn("norm", F.col("norm") * F.coalesce(norm_c, F.lit(0.0))).where("ref_idx is not null")
    length = lambda t: F.greatest(F.size(t) - 1, F.lit(0))
    both = samples.select("id", length(F.col("hyp")).alias("len_c"), F.posexplode(F.transform("refs", length)).alias("ref_idx", "len_r"))
    sims = sums.join(both, ["id", "ref_idx"]).withColumn("sim", F.when(F.col("norm") != 0, F.col("dot") / F.col("norm")).otherwise(F.col("dot")) * F.exp(-F.pow(F.col("len_c") - F.col("len_r"), F.lit(2)) / (2 * sigma * sigma)))
    out = samples.select("id", F.size("refs").alias("refs")).join(sims.groupBy("id").agg(F.sum("sim").alias("sim")), "id", "left")
    return out.select("id", (scale * F.coalesce("sim", F.lit(0.0)) / n / F.col("refs")).alias("cider_d"))


def corpus_score(sentences: DataFrame) -> DataFrame:
    return sentences.agg(F.avg("cider_d").alias("cider_d"))


def single(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (id, hyp, ref) as candidates and single references."""
    return pairs.select("id", F.col("hyp").alias("text")), pairs.select("id", F.lit(0).alias("ref_idx"), F.col("ref").alias("text"))


def spider(pairs: DataFrame) -> DataFrame:
    """The corpus score of single references times 100, to 4 places."""
    return corpus_score(sentence_scores(*single(pairs))).select(F.round(F.col("cider_d") * 100, 4).alias("spider"))


def shown(score: float) -> str:
    return f"SPIDEr: {score}"
