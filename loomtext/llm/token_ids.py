"""Token ids of whole texts by a byte-level tokenizer file; every distinct word is encoded once.

A blank between two characters that are not white space always begins a token of such tokenizers, so
a text may be cut before it. Words that are met again take their ids from a table; what is cut
otherwise (several blanks, line ends beside blanks) is encoded as it stands. Texts are walked in runs
of about ``RUN`` characters and long texts in segments of that size, so memory follows the run, and
the table is emptied when it holds about ``TABLE`` bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

RUN = 1 << 20
TABLE = 96 << 20
#: So many new words are encoded side by side.
BESIDE = 256

#: Characters that some tables of white space have and others don't; a text isn't cut beside them.
_DOUBTFUL = frozenset("\x1c\x1d\x1e\x1f\x85᠎​⁠﻿")


def _solid(c: str) -> bool:
    return not c.isspace() and c not in _DOUBTFUL


class _Numbers(dict):
    """The number of each distinct word, in order of appearance."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class TokenIds:
    """``ids`` of texts, each ended by ``end_id``; ``path`` names a tokenizer file of the library tokenizers."""

    def __init__(self, path: str, end_id: int = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.width = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[n for t, n in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True  # the byte 0x20 as such tokenizers write it
        steps = self.tokenizer.pre_tokenizer
        self.cuttable = type(steps).__name__ == "ByteLevel" and steps.use_regex and self.tokenizer.normalizer is None
        self._empty_table()

    def _empty_table(self) -> None:
        self.numbers, self.held = _Numbers(), 0
        self.flat = np.zeros(0, np.uint32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.head, self.tail = np.zeros(0, bool), np.zeros(0, bool)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the words that are new, each with a blank before it. Words of solid ends are encoded side by
        side: between them, a token that begins with a blank begins a word."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        head = np.fromiter((bool(w) and _solid(w[0]) for w in new), bool, len(new))
        tail = np.fromiter((bool(w) and _solid(w[-1]) for w in new), bool, len(new))
        count = np.zeros(len(new), np.int64)
        beside = np.flatnonzero(head & tail if self.cuttable else np.zeros(len(new), bool))
        parts = [f" {' '.join([new[k] for k in beside[at : at + BESIDE]])}" for at in range(0, len(beside), BESIDE)]
        solid = np.array([t for i in self.encoded(parts) for t in i], np.int64)
        opens = np.flatnonzero(self.opens[solid]) if len(solid) else np.zeros(0, np.int64)
        if len(opens) != len(beside):  # a tokenizer that merges otherwise
            beside, solid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            count[beside] = np.diff(np.append(opens, len(solid)))
        alone = np.setdiff1d(np.arange(len(new)), beside)
        ids = self.encoded([f" {new[k]}" for k in alone])
        count[alone] = [len(i) for i in ids]
        order = np.concatenate([beside, alone])  # as the ids stand one after another
        begin = np.empty(len(new), np.int64)
        begin[order] = len(self.flat) + np.cumsum(count[order]) - count[order]
        self.flat = np.concatenate([self.flat, solid.astype(np.uint32), np.array([t for i in ids for t in i], np.uint32)])
        self.start, self.count = np.concatenate([self.start, begin]), np.concatenate([self.count, count])
        self.head, self.tail = np.concatenate([self.head, head]), np.concatenate([self.tail, tail])
        self.held += sum(map(len, new)) + 64 * len(new)

    def _segments(self, text: str) -> Iterator[str]:
        """A long text in parts that begin with a blank between solid characters, but for the first."""
        at = 0
        while len(text) - at > RUN:
            cut = text.find(" ", at + RUN)
            while 0 < cut < len(text) - 1 and not (_solid(text[cut - 1]) and _solid(text[cut + 1])):
                cut = text.find(" ", cut + 1)
            if not 0 < cut < len(text) - 1:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _run(self, parts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of (part, whether its text ends here), with the end id where it does; and where parts end."""
        if self.held > TABLE:
            self._empty_table()
        words: list[str] = []
        size = []
        blank = []  # whether a part begins with a blank, which then belongs to its first word
        for part, _ in parts:
            blank.append(part.startswith(" "))
            own = (part[1:] if blank[-1] else part).split(" ")
            words += own
            size.append(len(own))
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn()
        begins = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        first = np.zeros(len(words), bool)
        first[begins] = True
        cut = first.copy()
        cut[1:] |= self.tail[number[:-1]] & self.head[number[1:]]
        if not self.cuttable:
            cut = first.copy()
        lead = np.ones(len(words), bool)  # words that a blank stands before
        lead[begins] = blank
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(words))
        plain = (ends - starts == 1) & lead[starts]
        odd = np.flatnonzero(~plain)
        ids = self.encoded([(" " if lead[starts[k]] else "") + " ".join(words[starts[k] : ends[k]]) for k in odd])
        flat = np.concatenate([self.flat, np.array([t for i in ids for t in i], np.uint32), np.array([self.end_id], np.uint32)])
        begin, count = self.start[number[starts]], self.count[number[starts]]
        count[odd] = [len(i) for i in ids]
        begin[odd] = len(self.flat) + np.cumsum(count[odd]) - count[odd]
        # the end id as one more entry where a text ends
        of_part = np.searchsorted(starts, begins)
        after = np.append(of_part[1:], len(starts))
        ended = np.array([e for _, e in parts], bool)
        begin, count = np.insert(begin, after[ended], len(flat) - 1), np.insert(count, after[ended], 1)
        through = np.cumsum(count)
        place = np.repeat(begin - (through - count), count) + np.arange(through[-1] if len(through) else 0)
        return flat[place].astype(self.width), through[after + np.cumsum(ended) - 1]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        parts: list[tuple[str, bool]] = []
        held: list[np.ndarray] = []
        chars = 0

        def done() -> Iterator[np.ndarray]:
            flat, ends = self._run(parts)
            at = 0
            for (_, over), to in zip(parts, ends.tolist(), strict=True):
                held.append(flat[at:to])
                at = to
                if over:
                    yield held[0] if len(held) == 1 else np.concatenate(held)
                    held.clear()

        for text in texts:
            own = list(self._segments(text)) if len(text) > RUN and self.cuttable else [text]
            for k, part in enumerate(own):
                parts.append((part, k == len(own) - 1))
                chars += len(part) + 8
                if chars >= RUN:
                    yield from done()
                    parts, chars = [], 0
        if parts:
            yield from done()


_ready: dict[tuple[str, int], TokenIds] = {}


def ready(path: str | None, end_id: int) -> TokenIds:
    """The tokenizer of a worker, with the words that its earlier tasks have met. No path: the public byte-level file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if (path, end_id) not in _ready:
        _ready[path, end_id] = TokenIds(path, end_id)
    return _ready[path, end_id]
