"""Whole Arrow batches of texts as word arrays: byte tables, cumulative sums and sorts, never a loop over words.

A batch is cut into runs of whole documents of about ``CHUNK`` bytes (one longer document is a run
by itself), so memory follows the chunk or the longest document, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

_ALL = np.arange(256)
_SPACE = (_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
#: Words of ``[^\x20\x09-\x0D]+``, byte by byte.
SPACED = ~_SPACE
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, small letters and all that is not ASCII.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: A-Z to a-z, other bytes as they are.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_Q_INV = tuple(pow(q, -1, 1 << 64) for q in _Q)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """Words of the documents ``first .. first + docs - 1`` of a batch.

    ``data`` holds the (maybe lower-cased) bytes; word k is ``data[starts[k]:ends[k]]``; document d
    has the words ``bounds[d]:bounds[d + 1]`` and the bytes ``offsets[d]:offsets[d + 1]``.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of(self) -> np.ndarray:
        """Of each word, its document within this run."""
        return np.repeat(np.arange(self.docs), np.diff(self.bounds))

    def left(self) -> np.ndarray:
        """Of each word, how many words its document has from it on, itself included."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_P, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * powers(_P_INV, n + 1)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


class Letters:
    """UTF-8 words, and hashes of them without one of their letters; word k is ``data[begin[k]:end[k]]``."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end = begin, end
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_P, len(data)), out=self.total[1:])
        self.back = powers(_P_INV, len(data) + 1)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # where letters begin
        self.low, self.high = np.searchsorted(lead, begin), np.searchsorted(lead, end)
        self.lead = np.append(lead, len(data))

    @classmethod
    def of_texts(cls, texts: list[str]) -> Letters:
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(c) for c in coded], dtype=np.int64)
        return cls(np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if texts else ends, ends)

    def _hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[begin]) * self.back[begin]

    def whole(self) -> np.ndarray:
        return self._hash(self.begin, self.end)

    def begins(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first n letters of the words that have as many."""
        which = np.flatnonzero(self.high - self.low >= n)
        return which, self._hash(self.begin[which], self._place(which, n))

    def _place(self, which: np.ndarray, n: int) -> np.ndarray:
        """Where the letter n of each word begins, or where the word ends."""
        at = self.low[which] + n
        return np.where(at < self.high[which], self.lead[np.minimum(at, len(self.lead) - 1)], self.end[which])

    def without_one(self, m: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of each word, or of the first m letters of longer ones, without each of its letters."""
        size = self.high - self.low
        which = np.arange(len(size)) if m is None else np.flatnonzero(size > m)
        count = size[which] if m is None else np.full(len(which), m)
        word = np.repeat(which, count)
        letter = np.repeat(self.low[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        stop = np.repeat(self.end[which] if m is None else self._place(which, m), count)
        at, after = self.lead[letter], np.minimum(self.lead[letter + 1], stop)
        begin = self.begin[word]
        head = (self.total[at] - self.total[begin]) * self.back[begin]
        # what follows moves to the letter's place
        tail = (self.total[stop] - self.total[after]) * self.back[begin + (after - at)]
        return word, head + tail

    def flagged(self, word: np.ndarray, hashes: np.ndarray, keys: Keys) -> np.ndarray:
        """Which words have a hash among the keys."""
        out = np.zeros(len(self.begin), bool)
        out[word[keys.has(hashes)]] = True
        return out


class Keys:
    """A set of hashes: a small table says no to nearly all that aren't in it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << 18, bool)
        self.table[self._cell(self.sorted)] = True

    def __len__(self) -> int:
        return len(self.sorted)

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Places of those that are in the set."""
        maybe = np.flatnonzero(self.table[self._cell(hashes)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), max(0, len(self.sorted) - 1))
        return maybe[self.sorted[at] == hashes[maybe]] if len(maybe) else maybe


def window_sums(h: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which ``window_hashes`` takes any window."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((mix(h) if which else h) * powers(_Q[which], len(h)), out=total[1:])
    return total


def window_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the words start..end-1, alike wherever the same words stand."""
    return mix((sums[end] - sums[start]) * powers(_Q_INV[which], len(sums))[start])


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, first: int = 0) -> Words:
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = word[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cut = offsets[(offsets < n) & (offsets > 0)]
    before[cut] = False
    after[cut - 1] = False
    here = inside[1:-1]
    starts = np.flatnonzero(here & ~before)
    ends = np.flatnonzero(here & ~after) + 1
    return Words(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def word_runs(texts: pa.Array, word: np.ndarray = SPACED, lower: bool = False, chunk: int = CHUNK) -> Iterator[Words]:
    """The words of all texts, in runs of whole documents of about ``chunk`` bytes."""
    data, offsets = column_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        to = min(to, n)
        part = data[offsets[at] : offsets[to]]
        yield split_words(LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at], word, at)
        at = to


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, starts + lengths, 1)
    return np.cumsum(steps[:-1]) > 0
