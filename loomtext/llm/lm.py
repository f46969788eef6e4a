"""A word bigram model in sharded Elias-Fano tries, and the scores of whole texts under it.

The model: p(w | u) = c(u w) / (c(u) + MU) + MU / (c(u) + MU) * p(w), with p(w) = (c(w) + 0.5) / (N +
0.5 (V + 1)); a proper distribution over the V known words and one unknown. A trie holds contexts,
below each its successors, and for every pair the first term, the smoothed probability, as a
quantised log10; pointers and keys are monotone sequences in Elias-Fano code, one flat image that can
be mapped from a file. Queries search the levels as they are: a directory of bit counts leads to a
value's high bits, a few steps among its low bytes to the value; no level is decoded.

Counts cover every training document. What is gathered grows with the corpus and is dealt by key:

1. Blocks of documents send each distinct word with its count; buckets send back total counts, and
   whether other blocks have the word (and add up N and V).
2. Blocks send the pairs that other blocks may also have, below their contexts; each bucket sums
   them, builds its trie and answers every pair from it. A context of more than ``SLICE`` tokens is
   dealt to several tries by its successors, so the commonest words don't meet in one task. Contexts
   are known by 64 bits, their successors (a million in a trie at most) by 48. Pairs with a word that
   only one block has are in a trie of that block.
3. Blocks score their documents.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, crc_mod, need, partitions
from .substring_dedup import _requests, _sizes
from .text import SPACED, mix, word_runs

MU = 50.0
#: Tokens that follow a context in one trie.
SLICE = 1 << 20
#: log10 probabilities are kept in steps of STEP decades; the last code stands for none.
STEP, NONE = 0.04, 255
END, START = np.uint64(0x454E44), np.uint64(0x53544152)
CTX_BYTES, WORD_BYTES = 8, 6


#: Of each octet, where its ones stand, the highest bit first; zeros come after.
_BIT_OF_RANK = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, kind="stable")


class EliasFano:
    """A monotone sequence: low bits in whole bytes, high bits as a bitmap of their unary differences, and
    how many ones stand before each 64 bits of it."""

    def __init__(self, n: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low, self.high, self.ranks = n, low.reshape(n, -1) if n else low.reshape(0, 0), high.reshape(-1, 8), ranks
        self.low_bytes = self.low.shape[1]

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bytes = min(7, (max(0, (top // max(n, 1)).bit_length() - 1) + 7) // 8)
        ones = (values >> np.uint64(8 * low_bytes)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) // 64 + 2) * 64 if n else 64
        bitmap = np.zeros(size, np.uint8)
        bitmap[ones] = 1
        ranks = np.concatenate([[0], np.cumsum(np.bincount(ones // 64, minlength=size // 64))[:-1]])
        return cls(n, blocks.pack(values, low_bytes).ravel(), np.packbits(bitmap), ranks.astype(np.uint32))

    def _select(self, wanted: np.ndarray, one: bool) -> np.ndarray:
        """Places of the wanted-th ones, or zeros, of the bitmap."""
        before = self.ranks if one else np.arange(len(self.ranks)) * 64 - self.ranks
        chunk = np.searchsorted(before, wanted, "right") - 1
        octets = self.high[chunk] if one else ~self.high[chunk]
        through = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)  # ones up to and with each octet
        rank = (wanted - before[chunk]).astype(np.uint8)
        octet = (through <= rank[:, None]).argmin(axis=1)
        own = np.arange(len(octet))
        value = octets[own, octet]
        rank -= through[own, octet] - np.bitwise_count(value)
        return chunk * 64 + octet * 8 + _BIT_OF_RANK[value, rank]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(self.low_bytes):
            out |= self.low[at, k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        out = np.zeros(len(at), np.uint64)
        for a in range(0, len(at), _QUERIES):
            part = at[a : a + _QUERIES]
            high = (self._select(part, True) - part).astype(np.uint64)
            out[a : a + _QUERIES] = high << np.uint64(8 * self.low_bytes) | self._lows(part)
        return out

    def search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the place of the first that is not less, and whether it is equal."""
        out, equal = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        if self.n:
            for a in range(0, len(values), _QUERIES):
                out[a : a + _QUERIES], equal[a : a + _QUERIES] = self._search(values[a : a + _QUERIES])
        return out, equal

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zeros = 64 * len(self.ranks) - self.n
        part = values >> np.uint64(8 * self.low_bytes)
        beyond = part >= np.uint64(zeros)  # more than any value
        part = np.where(beyond, 0, part).astype(np.int64)
        high = np.minimum(self._select(part, False) - part, self.n)  # those with a greater high part begin here
        low = np.where(part > 0, np.minimum(self._select(np.maximum(part - 1, 0), False) + 1 - part, self.n), 0)
        low = np.where(beyond, self.n, low)
        end, wanted = high.copy(), values & np.uint64((1 << 8 * self.low_bytes) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            less = self._lows(mid) < wanted[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        equal = low < end
        equal[equal] = self._lows(low[equal]) == wanted[equal]
        return low, equal

    def to_bytes(self) -> bytes:
        sizes = struct.pack("<QQQQ", self.n, self.low.size, self.high.size, len(self.ranks))
        return sizes + self.ranks.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data, at: int) -> tuple[EliasFano, int]:
        n, low, high, ranks = struct.unpack_from("<QQQQ", data, at)
        at += 32
        r = np.frombuffer(data, np.uint32, ranks, at)
        at += 4 * ranks
        return cls(n, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), r), at + low + high


#: Queries that a level answers at once.
_QUERIES = 1 << 17


class Trie:
    """Contexts, the words that follow any, pointers to successors, successors, and a quantised log10 for each.

    Successors of a context are ranks among the words, kept relative to the largest of all contexts
    before it, so the whole level is one monotone sequence; a pair is found by a search for the
    context, one for the word, and one for its rank relative to the context. ``to_bytes`` is a flat image.
    """

    def __init__(self, contexts: EliasFano, words: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.words, self.pointers, self.successors, self.codes = contexts, words, pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Trie:
        """From pairs sorted by context, then word."""
        fresh = np.ones(len(context), bool)
        fresh[1:] = context[1:] != context[:-1]
        heads = np.flatnonzero(fresh)
        pointers = np.append(heads, len(context))
        words, rank = np.unique(word, return_inverse=True)
        last = rank[pointers[1:] - 1] if len(heads) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(last[:-1] + 1)]) if len(heads) else last
        relative = rank + np.repeat(base, np.diff(pointers))
        return cls(*map(EliasFano.encode, (context[heads], words, pointers, relative)), codes.astype(np.uint8))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair; NONE where there is none."""
        return self.find_among(*np.unique(context, return_inverse=True), *np.unique(word, return_inverse=True))

    def find_among(self, contexts: np.ndarray, of_context: np.ndarray, words: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """The same for pairs of places among distinct contexts and words."""
        out = np.full(len(of_context), NONE, np.uint8)
        if not self.contexts.n or not len(of_context):
            return out
        at, known = self.contexts.search(contexts.astype(np.uint64))
        at = np.where(known, at, 0)
        begin, end = (self.pointers.get(at + k).astype(np.int64) for k in (0, 1))
        # the greatest relative value of a context is where the next one's begin
        base = np.where(begin > 0, self.successors.get(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
        rank, met = self.words.search(words.astype(np.uint64))
        ask = np.flatnonzero(known[of_context] & met[of_word])
        c = of_context[ask]
        place, equal = self.successors.search(rank[of_word[ask]].astype(np.uint64) + base[c])
        ok = equal & (place >= begin[c]) & (place < end[c])
        out[ask[ok]] = self.codes[place[ok]]
        return out

    def to_bytes(self) -> bytes:
        return b"".join(x.to_bytes() for x in (self.contexts, self.words, self.pointers, self.successors)) + self.codes.tobytes()

    @classmethod
    def from_buffer(cls, data) -> Trie:
        """Over bytes or a mapped file; nothing is copied."""
        at, levels = 0, []
        for _ in range(4):
            level, at = EliasFano.read(data, at)
            levels.append(level)
        return cls(*levels, np.frombuffer(data, np.uint8, offset=at))


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 is NONE, and what is less than the least code's is that code."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) / STEP)
    return np.where(p > 0, np.minimum(code, NONE - 1), NONE).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    table = 10.0 ** (-STEP * np.arange(256))
    table[NONE] = 0.0
    return table[codes]


class Block:
    """A block's tokens: every document's lower-cased words, then one end."""

    def __init__(self, table: pa.Table):
        self.train = ~table.column("held_out").to_numpy()
        words, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for run in word_runs(table.column("text"), SPACED, lower=True):
            own = np.full(len(run) + run.docs, END)
            own[np.arange(len(run)) + run.doc_of()] = run.hashes()
            words.append(own)
            lengths.append(np.diff(run.bounds) + 1)
        self.lengths = np.concatenate(lengths)
        self.keys, self.token = np.unique(np.concatenate(words), return_inverse=True)
        self.trained = np.repeat(self.train, self.lengths)
        self.own = np.bincount(self.token[self.trained], minlength=len(self.keys))

    def cuts(self, buckets: int) -> np.ndarray:
        return blocks.cut_points(self.keys, buckets)

    def totals(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its training count, and whether several blocks have it."""
        (counts,) = blocks.rows_by_bucket(answers, "answer", kind=0)
        both = np.frombuffer(b"".join(counts), np.int64)
        return both >> 1, both & 1 == 1

    def pairs(self) -> None:
        """Distinct (context, word) with their training counts; context len(keys) is the start."""
        n = len(self.keys)
        context = np.empty(len(self.token), np.int64)
        context[1:] = self.token[:-1]
        context[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = n
        self.pair, self.pair_of = np.unique(context * n + self.token, return_inverse=True)
        self.context, self.word = self.pair // n, self.pair % n
        self.pair_own = np.bincount(self.pair_of[self.trained], minlength=len(self.pair))

    def asked(self, total: np.ndarray, several: np.ndarray) -> Pairs:
        """The pairs that other blocks may have too, in the order of their tries."""
        end = int(np.searchsorted(self.keys, END))
        context_total = np.append(total, total[end])  # each text starts once and ends once
        shared = np.append(several, several[end])[self.context] & several[self.word] & (total[self.word] > 0) & (context_total[self.context] > 0)
        which = np.flatnonzero(shared)
        c, w = self.context[which], self.keys[self.word[which]]
        slices = (context_total[c] // SLICE + 1).astype(np.uint64)
        key = mix(np.append(self.keys, START)[c] + (w >> np.uint64(40)) % slices * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8 * CTX_BYTES)
        words = mix(self.keys) >> np.uint64(64 - 8 * WORD_BYTES)
        of_key, of_word = np.unique(key, return_inverse=True)[1], np.empty(len(words), np.int64)
        of_word[np.argsort(words)] = np.arange(len(words))
        word, order = words[self.word[which]], np.argsort(of_key * len(words) + of_word[self.word[which]])
        return Pairs(which[order], key[order], word[order], context_total[c][order], context_total)


@dataclass
class Pairs:
    which: np.ndarray
    key: np.ndarray
    word: np.ndarray
    context_count: np.ndarray
    context_total: np.ndarray

    def cuts(self, buckets: int) -> np.ndarray:
        return blocks.cut_points(self.key << np.uint64(64 - 8 * CTX_BYTES), buckets)


def _send_words(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block = Block(table)
        return _requests(table.column("blk")[0].as_py(), block.cuts(buckets), keys=block.keys, counts=block.own.astype(np.int64))

    return send


def _answer_words(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, counts)
    tokens, known = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    tokens[0], known[0] = total.sum(), (total > 0).sum()
    return _answers(table, parts, (2 * total + (np.bincount(at) > 1))[at], 0).append_column("tokens", pa.array(tokens)).append_column("known", pa.array(known))


def _answers(table: pa.Table, parts: list, values: np.ndarray, kind: int) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])
    out = [values[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)]
    kinds = pa.array([kind] * len(out), pa.int32())
    return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"), "kind": kinds, "answer": pa.array(out, pa.binary())})


def _send_pairs(buckets: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        block.pairs()
        asked = block.asked(*block.totals(answers))
        cuts = asked.cuts(buckets)
        rows = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        out: dict[str, list] = {k: [] for k in ("contexts", "counts", "degrees", "words", "own")}
        for b in rows:
            part = slice(cuts[b], cuts[b + 1])
            key, heads, degrees = np.unique(asked.key[part], return_index=True, return_counts=True)
            out["contexts"].append(blocks.pack(key, CTX_BYTES).tobytes())
            out["counts"].append(asked.context_count[part][heads].tobytes())
            out["degrees"].append(degrees.astype(np.uint32).tobytes())
            out["words"].append(blocks.pack(asked.word[part], WORD_BYTES).tobytes())
            out["own"].append(block.pair_own[asked.which[part]].astype(np.uint32).tobytes())
        blk = table.column("blk")[0].as_py()
        ids = {"bucket": pa.array(rows, pa.int32()), "blk": pa.array([blk] * len(rows), pa.int32())}
        return pa.table(ids | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    return send


def _answer_pairs(table: pa.Table) -> pa.Table:
    col = lambda name: b"".join(table.column(name).to_pylist())
    parts = [np.frombuffer(x, np.uint32) for x in table.column("own").to_pylist()]
    degrees = np.frombuffer(col("degrees"), np.uint32)
    contexts, of_context = np.unique(blocks.unpack(col("contexts"), CTX_BYTES), return_inverse=True)
    of_context = np.repeat(of_context, degrees)
    count = np.repeat(np.frombuffer(col("counts"), np.int64), degrees)
    words, of_word = np.unique(blocks.unpack(col("words"), WORD_BYTES), return_inverse=True)
    pair = of_context * len(words) + of_word
    order = np.argsort(pair)
    ordered = pair[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(fresh)
    total = np.add.reduceat(np.concatenate(parts)[order].astype(np.int64), heads)
    seen = total > 0
    heads = order[heads[seen]]
    trie = Trie.build(contexts[of_context[heads]], words[of_word[heads]], quantise(total[seen] / (count[heads] + MU)))
    trie = Trie.from_buffer(trie.to_bytes())
    return _answers(table, parts, trie.find_among(contexts, of_context, words, of_word), 1)


def _score(buckets: int, tokens: int, known: int):
    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(blocks.opened(table))
        block.pairs()
        total, several = block.totals(answers)
        asked = block.asked(total, several)
        (codes,) = blocks.rows_by_bucket(answers, "answer", kind=1)
        below = asked.context_total.astype(float) + MU
        code = np.full(len(block.pair), NONE, np.uint8)
        code[asked.which] = np.frombuffer(b"".join(codes), np.uint8)
        own = np.ones(len(block.pair), bool)  # pairs that no other block can have
        own[asked.which] = False
        seen = np.flatnonzero(own & (block.pair_own > 0))
        trie = Trie.build(block.context[seen], block.word[seen], quantise(block.pair_own[seen] / below[block.context[seen]]))
        code[own] = trie.find(block.context[own], block.word[own])
        base = (total + 0.5) / (tokens + 0.5 * (known + 1))
        pair = np.log10(restore(code) + MU / below[block.context] * base[block.word])
        starts = np.concatenate([[0], np.cumsum(block.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no document is without its end
        out = {"row": table.column("row"), "held_out": table.column("held_out")}
        out |= {"n_tokens": pa.array(block.lengths), "n_known": pa.array(add((total > 0)[block.token].astype(np.int64)))}
        out |= {"base_score": pa.array(add(np.log10(base)[block.token])), "score": pa.array(add(pair[block.pair_of]))}
        return pa.table(out)

    return score


def score_texts(documents: DataFrame, held_out: Column, scratch: Scratch | None = None) -> DataFrame:
    """``row`` (every column of ``documents``), held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where ``held_out`` is false; it scores all of them. A null or
    empty text is its end alone. Equal rows count as often as they stand. Without training rows
    nothing is known, and every word gets the same probability.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    buckets = partitions(spark)
    held_out = F.coalesce(held_out, F.lit(False))
    whole = blocks.dealt_rows(documents, held_out=held_out)
    texts = blocks.dealt(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")))
    answer = "blk int, bucket int, kind int, answer binary"
    asked = blocks.ask(texts, _send_words(buckets), "bucket int, blk int, keys binary, counts binary")
    words = scratch.write("words", blocks.answer(asked, _answer_words, answer + ", tokens long, known long"), large=True)
    sums = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    words = words.drop("tokens", "known")
    pair = "bucket int, blk int, contexts binary, counts binary, degrees binary, words binary, own binary"
    asked = blocks.resume(texts, words, _send_pairs(buckets), pair)
    pairs = scratch.write("pairs", blocks.answer(asked, _answer_pairs, answer), large=True)
    schema = whole.select("row", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    out = blocks.resume(whole, words.unionByName(pairs), _score(buckets, sums["n"], sums["v"]), schema)
    return out.withColumn("train_tokens", F.lit(sums["n"]).cast("long"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    scored = score_texts(docs, crc_mod("doc_id", 5) == 1)
    return scored.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
