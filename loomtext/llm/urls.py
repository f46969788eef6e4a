"""URL filter: rules first, then host word segmentation and multinomial naive Bayes.

Host names run words together; a unigram model over the words of all pages (counts of every word of
two letters or more in the text of the pages) splits each part of a host by Viterbi into its
likeliest words. The segmented host and path tokens are the features of a multinomial naive Bayes
whose examples are the pages that the rules judge; every other page gets the class that it says.

Scale: word counts are summed within tasks and stay a table. What is asked of it is small: the
substrings of the distinct parts of hosts, joined to it by key; parts are split once each, and hosts
carry their words to the pages by a join. Token counts are summed in 2**18 hashed cells; those, some
MB at any input, are all that is broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need

#: (rule, verdict): a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
CELLS = 1 << 18
TOKEN = re.compile(r"[^\W_]+")
#: Parts of a host, for the JVM.
PART = r"[\p{L}\p{N}]+"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.coalesce(_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged_by(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Equally long ones: the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):
        name, _, path_start = r.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{path_start}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a name under the unigram model; letters that no word covers stay together.

    A letter by itself has a tenth of the probability of a word that stands once. Of equally likely
    ways the one whose last words are longest wins.
    """
    unknown = math.log(0.1 / total)
    lengths = sorted({len(w) for w in counts}, reverse=True)
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for size in lengths:
            if size <= end and (n := counts.get(name[end - size : end])):
                p = best[end - size] + math.log(n / total)
                if p > best[end]:
                    best[end], back[end] = p, end - size
        if best[end - 1] + unknown > best[end]:
            best[end], back[end] = best[end - 1] + unknown, -1
    out: list[str] = []
    end, loose = len(name), False
    while end:
        if back[end] < 0:
            out[-1:] = [name[end - 1] + out[-1]] if loose else [*out[-1:], name[end - 1]]
            end, loose = end - 1, True
        else:
            out.append(name[back[end] : end])
            end, loose = back[end], False
    return out[::-1]


def tokens(host: str, path: str, words: list[str]) -> list[str]:
    """The host's words, its last labels, and the words of the path, marked by where they stand."""
    labels = host.split(".")
    out = [f"h:{w}" for w in words]
    out += [f"t:{'.'.join(labels[-n:])}" for n in (1, 2) if len(labels) >= n]
    return out + [f"p:{'0' if w.isdigit() else w.lower()}" for w in TOKEN.findall(path)]


def cell(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & (CELLS - 1)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of every word of two letters or more in the pages' text."""
    plain = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    word = pages.select(F.explode_outer(F.split(F.lower(plain), r"[^\p{L}]+")).alias("word")).where("length(word) > 1")
    return word.groupBy("word").agg(F.count("*").alias("n"))


#: Words of up to so many letters are looked up as they are, so a part of a host makes so many rows a letter at most.
LOOKED_UP = 32


def host_words(hosts: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, words) of distinct ``hosts`` (name): the words of their parts in order."""
    parts = hosts.select("name", F.posexplode(F.expr(f"regexp_extract_all(name, r'{PART}', 0)")).alias("at", "part"))
    short = F.length("word") <= LOOKED_UP
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_set(F.when(short, F.length("word"))).alias("sizes"), F.bool_or(~short).alias("long")).first()
    total, sizes = sums["n"] + 1, sorted(sums["sizes"])  # at most LOOKED_UP
    one = parts.select("part").distinct().withColumn("id", F.sha2("part", 256))  # rows of letters carry the digest, not the part
    begins = F.transform(F.sequence(F.lit(1), F.length("part")), lambda b: F.struct(b.alias("b"), F.substring(F.col("part"), b, F.lit(LOOKED_UP + 1)).alias("ahead")))
    begin = one.select("id", F.inline(begins))
    fitting = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("ahead"))
    pieces = begin.select("id", "ahead", F.explode(fitting).alias("size")).select("id", F.expr("substring(ahead, 1, size)").alias("word"))
    known = pieces.join(counts.where(short), "word").select("id", "word", "n")
    if sums["long"]:  # a longer word is found by its beginning
        beginnings = counts.where(~short).select("word", "n", F.substring("word", 1, LOOKED_UP + 1).alias("ahead"))
        met = begin.where(F.length("ahead") > LOOKED_UP).join(beginnings, "ahead").join(one, "id").where(F.expr("substring(part, b, length(word)) = word"))
        known = known.unionByName(met.select("id", "word", "n"))
    known = known.groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("part").to_pylist(), batch.column("known").to_pylist(), strict=True)
            words = [split(part, {x["word"]: x["n"] for x in known or []}, total) for part, known in rows]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(words, pa.list_(pa.string()))], ["part", "words"])

    cuts = scratch.write("parts", one.join(known, "id", "left").select("part", "known").mapInArrow(cut, "part string, words array<string>"))
    each = parts.join(cuts, "part").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("x"))
    return each.select("name", F.flatten(F.col("x.words")).alias("words"))


def bayes(judged: DataFrame) -> np.ndarray:
    """log p(token | block) - log p(token | allow) of each cell, and last the classes' own log ratio.

    ``judged`` is (host, path, words, blocked) of every page a rule judges; add-one smoothing. Without
    pages of both classes only the classes' ratio, smoothed too, is left.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], int] = {}
        for batch in batches:
            for host, path, words, blocked in zip(*[batch.column(c).to_pylist() for c in ("host", "path", "words", "blocked")], strict=True):
                for k in (*map(cell, tokens(host, path, words or [])), CELLS):
                    total[k, blocked] = total.get((k, blocked), 0) + 1
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["cell", "blocked", "n"])

    counts = np.zeros((2, CELLS + 1), np.int64)
    for r in judged.mapInArrow(count, "cell int, blocked boolean, n long").groupBy("cell", "blocked").agg(F.sum("n").alias("n")).collect():  # 2 * CELLS + 2 rows at most
        counts[int(r["blocked"]), r["cell"]] = r["n"]
    prior = math.log((counts[1, CELLS] + 1) / (counts[0, CELLS] + 1))
    if not counts[:, CELLS].all():
        return np.append(np.zeros(CELLS), prior)
    smooth = np.log(counts[:, :CELLS] + 1.0) - np.log(counts[:, :CELLS].sum(axis=1, keepdims=True) + CELLS)
    return np.append(smooth[1] - smooth[0], prior)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, corpus: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``row`` (every column of ``pages``), host, path, rule, verdict and ``log_odds`` (of block).

    The words are those of the column ``html`` of ``corpus``, which is ``pages`` unless given (so that
    whole pages needn't go along through the join to their hosts). Null urls and those without ://
    have an empty host and path, fit no rule, and get the verdict of the model, which for no tokens is
    the commoner class; ties allow. Equal rows are judged alike; a missing column counts as null.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    have = {c.lower() for c in pages.columns}
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    url = (F.col("row.url") if "url" in have else F.lit(None)).cast("string")
    whole = whole.select("row", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = judged_by(rules, F.col("host"), F.col("path"))
    whole = whole.withColumn("rule", rule).withColumn("by_rule", verdict)
    counts = scratch.write("words", word_counts(need(pages if corpus is None else corpus, html="string")))
    hosts = need(pages, url="string").select(host_of(F.col("url")).alias("name")).distinct()
    words = scratch.write("hosts", host_words(scratch.write("names", hosts), counts, scratch))
    urls = need(pages, url="string").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    _, verdict = judged_by(rules, F.col("host"), F.col("path"))
    urls = urls.withColumn("blocked", verdict == "block").where("blocked is not null")
    model = bayes(urls.join(words, urls.host == words.name, "left").select("host", "path", "words", "blocked"))
    held = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = held.value
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("host", "path", "words")], strict=True)
            out = [float(sum(odds[cell(t)] for t in tokens(host, path, own or [])) + odds[CELLS]) if host or path else float(odds[CELLS]) for host, path, own in rows]
            kept = [k for k in batch.schema.names if k != "words"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(out, pa.float64())], [*kept, "log_odds"])

    joined = whole.join(words, whole.host == words.name, "left").drop("name")
    out = joined.mapInArrow(score, whole.schema.add("log_odds", "double"))
    said = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("row", "host", "path", "rule", F.coalesce("by_rule", said).alias("verdict"), "log_odds")


def op6(spark, sf_dir: str) -> DataFrame:
    pages = need(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="long", url="string", html="string")
    return judge(pages.drop("html"), corpus=pages).select("row.page_id", "host", "path", "rule", "verdict")
