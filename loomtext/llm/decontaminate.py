"""Benchmark decontamination with sparse suffix arrays over shards of the training texts.

Every shard (a run of whole documents) gets the sorted array of its suffixes that can begin an
occurrence: those from which enough words in a row belong to the benchmark's vocabulary; no other
suffix can hold a whole window. Each test suffix is then binary-searched in it, and neighbouring
hits are joined into longest verbatim matches with their locations.

Scale: documents are only mapped over, with no shuffle. The benchmark is the stated query set: it
goes to the executors in blocks of at most ``block_words`` words, each about 100 bytes (a window's key
and where it stands), so 0.2 GB for a Python worker. A larger benchmark takes a pass for each block;
between passes the documents are written, so that no task holds two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need
from .text import ALNUM, covered, word_runs

WINDOW = 13
#: Words of the benchmark that are held by a task at once.
BLOCK_WORDS = 2_000_000


@dataclass
class TestBlock:
    """Some test items: their word hashes, and their windows as rows of vocabulary numbers."""

    ids: list[str]
    vocabulary: np.ndarray
    keys: np.ndarray  # one row of bytes for each distinct window, sorted
    above: np.ndarray  # the greatest row that begins like it
    lengths: np.ndarray  # words of each distinct window
    items: np.ndarray  # of each place where a window stands, by window: the item
    places: np.ndarray  # and the word
    bounds: np.ndarray  # window k stands at the places bounds[k]:bounds[k + 1]
    window: int
    seen: np.ndarray  # which hash prefixes the vocabulary has

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int) -> TestBlock:
        runs = list(word_runs(pa.array([r[1] for r in rows], pa.string()), ALNUM, lower=True)) if rows else []
        hashes = [r.hashes() for r in runs]
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        keys, sizes, items, places = [np.zeros(0, f"S{4 * window}")], [_NONE], [_NONE], [_NONE]
        for run, h in zip(runs, hashes, strict=True):
            left, words, doc = run.left(), np.diff(run.bounds), run.doc_of()
            at = np.arange(len(run)) - run.bounds[doc]
            start = np.flatnonzero((left >= window) | (at == 0) & (words[doc] < window))
            numbers = np.append(np.searchsorted(vocabulary, h) + 1, np.zeros(window, np.int64))
            table = np.where(np.arange(window) < left[start][:, None], numbers[start[:, None] + np.arange(window)], 0)
            keys.append(np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * window}").ravel())
            sizes.append(np.minimum(left[start], window))
            items.append(run.first + doc[start])
            places.append(at[start])
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        order, size = np.argsort(which, kind="stable"), np.zeros(len(every), np.int64)
        size[which] = np.concatenate(sizes)
        # a window of fewer words begins all rows up to itself and the greatest numbers
        filled = every.copy().view(np.uint8).reshape(-1, 4 * window)
        filled[np.arange(4 * window) >= 4 * size[:, None]] = 0xFF
        seen = np.zeros(1 << 16, bool)
        seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        bounds = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(every)))]).astype(np.int64)
        return cls(
            [r[0] for r in rows], vocabulary, every, filled.reshape(-1).view(f"S{4 * window}"), size,
            np.concatenate(items)[order], np.concatenate(places)[order], bounds, window, seen,
        )

    def occurrences(self, run, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) for each place of the run's words where a window stands."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(h):
            return none, none
        number = np.zeros(len(h) + self.window, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h[maybe]
        number[maybe[hit]] = at[hit] + 1
        # words in a row, from each word on, that are in the vocabulary and in the same document
        stops = np.zeros(len(h) + 1, bool)
        stops[-1] = True
        stops[:-1] = number[: len(h)] == 0
        where = np.flatnonzero(stops)
        ahead = where[np.searchsorted(where, np.arange(len(h)))] - np.arange(len(h))
        ahead = np.minimum(ahead, run.left())
        suffixes = np.flatnonzero(ahead >= self.lengths.min())
        if not len(suffixes):
            return none, none
        rows = number[suffixes[:, None] + np.arange(self.window)]
        rows[np.arange(self.window) >= ahead[suffixes][:, None]] = 0
        rows = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(rows, kind="stable")  # the suffix array, as deep as a window
        ordered, array = rows[order], suffixes[order]
        low = np.searchsorted(ordered, self.keys, "left")
        high = np.searchsorted(ordered, self.above, "right")
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        place = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return array[place], which


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[TestBlock]:
    """The test items in blocks of a bounded number of words (a longer item is a block by itself)."""
    rows: list[tuple[str, str]] = []
    size = 0
    items = need(benchmark, item_id="string", text="string").dropDuplicates()
    for item, text in items.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():
        words = len(text) // 2 + 1 if text else 0
        if rows and size + words > block_words:
            yield TestBlock.build(rows, window)
            rows, size = [], 0
        rows.append((item or "", text or ""))
        size += words
    yield TestBlock.build(rows, window)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``row`` (every column of ``documents``), ``n_words`` and ``matches``: longest verbatim matches with test items.

    ``matches`` is an array of (item_id, start, words): ``words`` words of the document from word
    ``start`` on stand in the item, at least a whole window of it. ``n_words`` is the document's
    length. Null or wordless texts have neither words nor matches; a null item_id reads as empty;
    items of fewer words than a window are one window, items without words none. Equal rows are
    treated alike, and a missing text column counts as null.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    have = {c.lower() for c in documents.columns}
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    out = out.select("row", (F.col("row.text") if "text" in have else F.lit(None)).cast("string").alias("text"))
    span = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
    out = out.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<item_id:string,start:bigint,words:bigint>>)").alias("matches"))
    for k, block in enumerate(_blocks(benchmark, window, block_words)):
        held = spark.sparkContext.broadcast(block)
        out = scratch.write(f"pass{k}", out) if k else out

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            test: TestBlock = held.value
            for batch in batches:
                texts = batch.column("text")
                lengths = np.zeros(batch.num_rows, np.int64)
                found: list[list] = batch.column("matches").to_pylist()
                for run in word_runs(texts, ALNUM, lower=True):
                    lengths[run.first : run.first + run.docs] = np.diff(run.bounds)
                    place, which = test.occurrences(run, run.hashes())
                    for d, spans in _joined(run, place, which, test).items():
                        found[run.first + d] += spans
                yield pa.RecordBatch.from_arrays([batch.column("row"), texts, pa.array(lengths), pa.array(found, span)], ["row", "text", "n_words", "matches"])

        out = out.mapInArrow(search, out.schema)
        if k > 1:
            scratch.drop(f"pass{k - 1}")
    return out.select("row", "n_words", "matches")


_NONE = np.zeros(0, np.int64)


def _joined(run, place: np.ndarray, which: np.ndarray, test: TestBlock) -> dict[int, list[dict]]:
    """Per document, occurrences at the same shift against an item that touch or overlap as one match."""
    out: dict[int, list[dict]] = {}
    if not len(place):
        return out
    counts = np.diff(test.bounds)[which]
    stands = np.repeat(test.bounds[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    item, at = test.items[stands], test.places[stands]
    start, length = np.repeat(place, counts), np.repeat(test.lengths[which], counts)
    doc, shift = np.searchsorted(run.bounds, start, "right") - 1, at - start
    order = np.lexsort((start, shift, item, doc))
    doc, item, shift, start, length = doc[order], item[order], shift[order], start[order], length[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > start[:-1] + length[:-1])
    heads = np.flatnonzero(fresh)
    ends = np.maximum.reduceat(start + length, heads)
    for d, i, s, e in zip(doc[heads].tolist(), item[heads].tolist(), start[heads].tolist(), ends.tolist(), strict=True):
        out.setdefault(d, []).append({"item_id": test.ids[i], "start": s - int(run.bounds[d]), "words": e - s})
    return out


def judge(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row`` (every column of ``documents``), n_words, n_hit, n_items, items_sha256 and contaminated.

    ``n_hit`` counts the document's words inside any occurrence of a window; a document is
    contaminated when that is at least one in ``share`` of its words.
    """
    found = matches(documents, benchmark, window, block_words)
    kept = [f for f in found.schema.fields if f.name != "matches"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            hit, items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [empty] * n
            spans = batch.column("matches")
            sizes = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(sizes).tolist():
                own = spans[k].as_py()
                starts, lengths = np.array([s["start"] for s in own]), np.array([s["words"] for s in own])
                hit[k] = covered(int((starts + lengths).max()), starts, lengths).sum()
                ids = sorted({s["item_id"] for s in own})
                items[k], sha[k] = len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(hit), pa.array(items), pa.array(sha, pa.string())], [*[f.name for f in kept], "n_hit", "n_items", "items_sha256"])

    schema = found.select(*[f.name for f in kept]).schema.add("n_hit", "long").add("n_items", "long").add("items_sha256", "string")
    judged = found.mapInArrow(digest, schema).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return judged.select(F.col("row"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    return judge(documents, benchmark, window, share).where(~F.col("contaminated")).select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
