"""Exact removal of long repeats, found by recompression.

Rounds of recompression replace runs of one symbol and pairs of symbols by new symbols: a round joins
each run, then splits the symbols into left and right ones by a hash of their names, and joins each
left-right pair. A name is a hash of what it stands for, so naming is global: it is the same in every
document without any exchange. What is joined depends on the symbols beside it alone; so equal
substrings get equal symbols but near their ends.

High symbols, the lowest ones of ``HIGH`` words and more, reveal long repeats: where one stands in a
document with a smaller doc_id too (their 128-bit hashes of all words tell), every window inside is
a repeat at once. What they leave, the ends of repeats and short ones, low symbols find: after two
rounds, with symbols of at most three words and runs not joined, a symbol depends on the four words
on either side of it, and each window of 13 words has at least one symbol that is the same wherever
the window stands (its five inner words always hold a whole symbol). Of those, every window marks
the one with the least name.

1. Blocks send the marked symbols' keys (name with the context that decides it, 6 bytes) and their
   high symbols with the least doc_id of each (24 bytes for some 40 words); buckets tell which keys
   are shared by several blocks, and which high symbols another block has in a smaller document.
2. Around shared low symbols, but not inside repeated high ones, blocks send 128-bit hashes of the
   whole windows with their least doc_id; buckets verify: they tell which windows a smaller doc_id of
   another block also has.
3. Blocks remove the covered words.

Texts move once for each of the three passes, keys a few bytes each; see ``blocks`` for hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import SPACES, Scratch, need, partitions
from .text import Words, covered, mix, window_hashes, window_sums, word_runs

WINDOW = 13
#: Words on either side of a symbol that decide it, and the words it may have; 2 * REACH + 2 * SPAN - 1 <= WINDOW.
REACH, SPAN = 4, 3
KEY_BYTES = 6
#: Words of a high symbol, at least; and rounds until nearly all text is in one.
HIGH, ROUNDS = 2 * WINDOW, 18
_NO = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A null doc_id is later than every other.
NO_ID = np.iinfo(np.int64).max


Symbols = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # names, first words, spans, documents


def _pairs(symbols: Symbols, seed: int, able: np.ndarray) -> Symbols:
    """One round: left-right neighbours of one document, if ``able`` (by the first one), are one symbol."""
    names, starts, spans, doc = symbols
    right = mix(names + np.uint64(seed)) >> np.uint64(63) == 1
    joined = np.zeros(len(names), bool)  # with the next one
    joined[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & able
    heads = np.ones(len(names), bool)
    heads[1:] = ~joined[:-1]
    first = np.flatnonzero(joined)
    names, spans = names.copy(), spans.copy()
    names[first] = mix(names[first] * np.uint64(0x9E3779B97F4A7C15) + mix(names[first + 1] + np.uint64(seed + 1)))
    spans[first] += spans[first + 1]
    return names[heads], starts[heads], spans[heads], doc[heads]


def _runs(symbols: Symbols) -> Symbols:
    """Neighbours of one name in one document are one symbol, named by what and how many."""
    names, starts, spans, doc = symbols
    heads = np.ones(len(names), bool)
    heads[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    if heads.all():
        return symbols
    first = np.flatnonzero(heads)
    many = np.diff(np.append(first, len(names)))
    joined = mix(names[first] * np.uint64(0xD6E8FEB86659FD93) + mix(many.astype(np.uint64)))
    return np.where(many > 1, joined, names[first]), starts[first], np.add.reduceat(spans, first), doc[first]


def high_symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and spans of the lowest symbols of HIGH words and more."""
    parts: Symbols = h, np.arange(len(h)), np.ones(len(h), np.int64), doc
    for r in range(ROUNDS):
        if not len(parts[0]):
            break
        parts = _runs(parts)
        low = parts[2] < HIGH
        parts = _pairs(parts, 0x5851F42D4C957F2D + 2 * r, low[:-1] & low[1:])
    _, starts, spans, _ = parts
    return starts[spans >= HIGH], spans[spans >= HIGH]


def symbols(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and spans of the symbols after two rounds over the words' hashes."""
    same = np.zeros(len(h) + 1, bool)  # as the word before
    same[1:-1] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    names = np.where(same[:-1] | same[1:], mix(h + np.uint64(0x52554E)), h)  # words of a run
    parts: Symbols = names, np.arange(len(h)), np.ones(len(h), np.int64), doc
    for seed in (0x1D8E4E27C47D124F, 0x60BEE2BEE120FC15):
        parts = _pairs(parts, seed, parts[2][:-1] + parts[2][1:] <= SPAN)
    return parts[:3]


def marked(run: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and spans of the symbols that are the least of some window."""
    names, starts, spans = symbols(h, run.doc_of())
    n = len(h)
    size = n + WINDOW
    at, span = np.full(size, _NO), np.zeros(size, np.int64)
    at[starts], span[starts] = np.minimum(names, _NO - np.uint64(1)), spans
    windows = run.left() >= WINDOW
    least = np.full(n, _NO)
    places = []
    for shift in range(REACH, WINDOW - REACH):
        most = WINDOW - REACH - shift  # words up to the part that the window can't vouch for
        here = at if most >= SPAN else np.where(span <= most, at, _NO)
        places.append((shift, here))
        np.minimum(least, here[shift : shift + n], out=least)
    chosen = np.zeros(size, bool)
    for shift, here in places:
        chosen[shift : shift + n] |= windows & (here[shift : shift + n] == least)
    picked = np.flatnonzero(chosen)
    return picked, span[picked]


@dataclass
class Part:
    """A run of a block's documents with its marked symbols and their keys, and its high symbols."""

    run: Words
    sums: tuple[np.ndarray, np.ndarray]
    at: np.ndarray
    span: np.ndarray
    keys: np.ndarray
    ids: np.ndarray  # doc_id of each document of the run
    high_at: np.ndarray
    high_span: np.ndarray

    def id_of(self, word: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.run.bounds, word, "right") - 1]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_hashes(self.sums[0], start, end), window_hashes(self.sums[1], start, end, 1)


class Block:
    def __init__(self, table: pa.Table):
        self.parts: list[Part] = []
        ids = table.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
        for run in word_runs(table.column("text")):
            h = run.hashes()
            sums = window_sums(h), window_sums(h, 1)
            at, span = marked(run, h)
            keys = window_hashes(sums[0], at - REACH, at + span + REACH) >> np.uint64(64 - 8 * KEY_BYTES)
            self.parts.append(Part(run, sums, at, span, keys, ids[run.first : run.first + run.docs], *high_symbols(h, run.doc_of())))
        every = [p.keys for p in self.parts]
        self.keys, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.repeated = counts > 1
        self.highs = Groups([(*p.hashes(p.high_at, p.high_at + p.high_span), p.id_of(p.high_at)) for p in self.parts])

    def cuts(self, buckets: int) -> np.ndarray:
        return blocks.cut_points(self.keys << np.uint64(64 - 8 * KEY_BYTES), buckets)

    def repeats(self, earlier: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By part, first words and spans of the high symbols that a smaller doc_id has; ``earlier``: in another block."""
        gone = self.highs.later(earlier)
        ends = np.cumsum([len(p.high_at) for p in self.parts])
        own = [gone[e - len(p.high_at) : e] for p, e in zip(self.parts, ends, strict=True)]
        return [(p.high_at[g], p.high_span[g]) for p, g in zip(self.parts, own, strict=True)]

    def windows(self, shared: np.ndarray, repeats: list[tuple[np.ndarray, np.ndarray]]) -> tuple[Groups, list[np.ndarray]]:
        """Every window around a shared low symbol that no repeated high symbol holds, and first words by part."""
        found, places = [], []
        for p, (high, size) in zip(self.parts, repeats, strict=True):
            hit = shared[np.searchsorted(self.keys, p.keys)]
            at, span = p.at[hit], p.span[hit]
            wanted = np.zeros(len(p.run) + WINDOW, bool)
            for back in range(REACH, WINDOW - REACH):
                ok = at + span + REACH <= at - back + WINDOW
                wanted[np.maximum(at[ok] - back, 0)] = True
            wanted = wanted[: len(p.run)] & (p.run.left() >= WINDOW) & ~covered(len(p.run), high, size - WINDOW + 1)
            start = np.flatnonzero(wanted)
            places.append(start)
            found.append((*p.hashes(start, start + WINDOW), p.id_of(start)))
        return Groups(found), places


class Groups:
    """Occurrences (two hashes, doc_id) grouped by their hashes; ``least`` of each group has the least doc_id."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        one, two, self.ids = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint64, np.int64)))
        self.order, fresh, group = _grouped(one, two, self.ids)
        self.least = self.order[fresh]
        self.group = np.empty(len(one), np.int64)
        self.group[self.order] = group
        self.ones, self.twos, self.firsts = one[self.least], two[self.least], self.ids[self.least]

    def cuts(self, buckets: int) -> np.ndarray:
        return blocks.cut_points(self.ones, buckets)

    def later(self, earlier: np.ndarray) -> np.ndarray:
        """Which occurrences a smaller doc_id has, of this block or, where a group is ``earlier``, of another."""
        return earlier[self.group] | (self.ids > self.firsts[self.group])


_NONE = np.zeros(0, np.uint64)


def _grouped(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (window, doc_id), which of those begin a window, and each one's window number."""
    order = np.lexsort((ids, two, one))
    a, b = one[order], two[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, fresh, np.cumsum(fresh) - 1


def _symbol_answers(answers: pa.Table, block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are shared, and which high symbols are in a smaller doc_id of another block."""
    flags, highs = blocks.rows_by_bucket(answers, "flags", "highs", kind=0)
    return blocks.bits(flags, np.diff(block.cuts(buckets))) | block.repeated, blocks.bits(highs, np.diff(block.highs.cuts(buckets)))


def _sizes(cuts: np.ndarray) -> np.ndarray:
    """Lengths of the parts that were sent: those that aren't empty."""
    sizes = np.diff(cuts)
    return sizes[sizes > 0]


def _requests(blk: int, cuts: np.ndarray, **columns: np.ndarray) -> pa.Table:
    rows = [b for b in range(len(cuts) - 1) if cuts[b + 1] > cuts[b]]
    out = {"bucket": pa.array(rows, pa.int32()), "blk": pa.array([blk] * len(rows), pa.int32())}
    return pa.table(out | {k: pa.array([v[cuts[b] : cuts[b + 1]].tobytes() for b in rows], pa.binary()) for k, v in columns.items()})


def _send_symbols(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        block = Block(table)
        low, high = block.cuts(buckets), block.highs.cuts(buckets)
        keys = blocks.pack(block.keys, KEY_BYTES)
        cut = lambda v, cuts: pa.array([v[cuts[b] : cuts[b + 1]].tobytes() for b in range(buckets)], pa.binary())
        ids = {"bucket": pa.array(range(buckets), pa.int32()), "blk": pa.array([table.column("blk")[0].as_py()] * buckets, pa.int32())}
        return pa.table(ids | {"keys": cut(keys, low), "ones": cut(block.highs.ones, high), "twos": cut(block.highs.twos, high), "ids": cut(block.highs.firsts, high)})

    return send


def _answer_symbols(table: pa.Table) -> pa.Table:
    parts = [blocks.unpack(x, KEY_BYTES) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    alike = np.zeros(len(keys) + 1, bool)
    alike[1:-1] = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order] = alike[:-1] | alike[1:]
    return _flags(table, parts, flags, 0).append_column("highs", _earlier(table).column("flags"))


def _earlier(table: pa.Table) -> pa.Table:
    """Flags of the occurrences that a smaller doc_id of another block has."""
    ones = [np.frombuffer(x, np.uint64) for x in table.column("ones").to_pylist()]
    two = np.frombuffer(b"".join(table.column("twos").to_pylist()), np.uint64)
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    found = Groups([(np.concatenate(ones), two, ids)])
    return _flags(table, ones, ids > found.firsts[found.group] if len(ids) else np.zeros(0, bool), 1)


def _flags(table: pa.Table, parts: list[np.ndarray], flags: np.ndarray, kind: int) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])
    out = [np.packbits(flags[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
    kinds = pa.array([kind] * len(out), pa.int32())
    return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"), "kind": kinds, "flags": pa.array(out, pa.binary())})


def _send_windows(buckets: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        shared, earlier = _symbol_answers(answers, block, buckets)
        found, _ = block.windows(shared, block.repeats(earlier))
        return _requests(table.column("blk")[0].as_py(), found.cuts(buckets), ones=found.ones, twos=found.twos, ids=found.firsts)

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    out = _earlier(table)
    return out.append_column("highs", pa.nulls(out.num_rows, pa.binary()))


def _remove(buckets: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = blocks.opened(table)
        block = Block(table)
        n = table.num_rows
        lengths, removed, changed, texts = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), []
        shared, earlier = _symbol_answers(answers, block, buckets)
        repeats = block.repeats(earlier)
        found, places = block.windows(shared, repeats)
        (flags,) = blocks.rows_by_bucket(answers, "flags", kind=1)
        gone = found.later(blocks.bits(flags, _sizes(found.cuts(buckets))))
        done = 0
        for p, start, (high, size) in zip(block.parts, places, repeats, strict=True):
            run = p.run
            out = covered(len(run), start[gone[done : done + len(start)]], WINDOW) | covered(len(run), high, size)
            done += len(start)
            total = np.concatenate([[0], np.cumsum(out)])[run.bounds]
            rows = slice(run.first, run.first + run.docs)
            lengths[rows], removed[rows] = np.diff(run.bounds), np.diff(total)
            for d in np.flatnonzero(removed[rows]).tolist():
                changed[run.first + d] = True
                texts.append(_kept(run, d, out))
        old = table.column("text").combine_chunks()
        new = pc.replace_with_mask(old, pa.array(changed), pa.array(texts, old.type)) if texts else old
        return pa.table({"row": table.column("row"), "kept_text": new, "n_words": pa.array(lengths), "n_removed": pa.array(removed)})

    return remove


def _kept(run: Words, d: int, out: np.ndarray) -> str:
    """A document's text without its removed words; white space between kept neighbours stays."""
    low, high = int(run.bounds[d]), int(run.bounds[d + 1])
    stays = np.zeros(high - low + 2, bool)
    stays[1:-1] = ~out[low:high]
    begins = np.flatnonzero(stays[1:] & ~stays[:-1]) + low
    ends = np.flatnonzero(~stays[1:] & stays[:-1]) + low - 1
    return b" ".join(run.data[run.starts[a] : run.ends[b]].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)).decode()


def remove_repeats(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``row`` (every column of ``documents``), ``kept_text``, ``n_words`` and ``n_removed``.

    A word goes if a window of 13 words that covers it also stands in a document with a smaller
    doc_id. Texts of which nothing goes stay as they are; null and empty texts have no words; equal
    doc_ids aren't smaller than one another, and a null doc_id is later than all others.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    buckets = partitions(spark)
    texts = blocks.dealt(need(documents, doc_id="long", text="string"))
    asked = blocks.ask(texts, _send_symbols(buckets), "bucket int, blk int, keys binary, ones binary, twos binary, ids binary")
    answer = "blk int, bucket int, kind int, flags binary, highs binary"
    symbols_shared = scratch.write("symbols", blocks.answer(asked, _answer_symbols, answer), large=True)
    asked = blocks.resume(texts, symbols_shared, _send_windows(buckets), "bucket int, blk int, ones binary, twos binary, ids binary")
    windows_earlier = scratch.write("windows", blocks.answer(asked, _answer_windows, answer), large=True)
    whole = blocks.dealt_rows(documents)
    schema = whole.select("row").schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return blocks.resume(whole, symbols_shared.unionByName(windows_earlier), _remove(buckets), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    found = remove_repeats(docs)
    words = F.regexp_replace(F.regexp_replace(F.coalesce("kept_text", F.lit("")), rf"^{SPACES}|{SPACES}\z", ""), SPACES, " ")
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
