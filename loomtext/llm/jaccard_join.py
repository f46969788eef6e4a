"""Exact Jaccard self-join of n-gram sets by prefix trees, and the components of its links.

Every document's set of n-gram hashes is put in one global order: by how often the n-gram's cell in
a sketch of fixed size, which counts all documents, is met, then by hash. Two sets
that are alike enough share an n-gram among the first few of each (the prefix), so rare n-grams
bring candidates together and common passages don't.

1. Blocks of documents send their prefix n-grams with their set's size (8 bytes each); buckets tell
   which ones other sets of a fitting size have. The rest, nearly all, is done with; the sets that
   have some are written once, and texts aren't read again.
2. Documents with equal sets are one class from here on. For each shared prefix n-gram and range of
   sizes, classes are linked to a leader by hash: stars, no pairs. Several hashes give a class some
   leaders; it is tried against the ``LEADERS`` with which it shares most. Counts of grams by cell (a
   quarter byte a gram) bound the overlap from above and drop candidates that can't reach the
   threshold. A leader's candidates (in chunks of ``CHUNK``) become a prefix tree; the leader's set
   walks down it.
3. Classes that are in one component already need no further pair. An n-gram whose classes are in
   different components is taken as a whole: what each of its sets holds after the n-gram goes into
   a prefix tree, and all of them walk down together, adding up overlaps along shared paths and
   leaving a subtree when what remains can't reach the threshold, or when it holds only their own
   component. What comes out is at most one link for each class (a forest of the components it
   joins), so nothing grows with pairs. Two sets meet in full at the first n-gram they share, where
   what follows it is all that they have in common: so no link between components is missed. More
   than ``GROUP`` sets of one n-gram are dealt to chunks, of which every two meet in a task. Of n-grams
   with at most ``FEW`` sets the pairs that could do are named instead and each is walked once, as long
   sets share many n-grams and would be sent for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, need, partitions
from .substring_dedup import _flags, _requests, _sizes
from .text import SPACED, Words, window_hashes, window_sums, word_runs

CELLS = 1 << 20
SLICES = 64
#: Leaders that a class is tried against: those with which it shares most prefix n-grams.
LEADERS = 3
CHUNK = 256
#: Sets of one n-gram up to which pairs are named: half of it for each set at most.
FEW = 16
#: Sets of one n-gram that a task puts into a tree.
GROUP = 2048
GROUP_BYTES = 32 << 20
#: Bits of a key that tell the set's size; larger sizes count as the largest.
SIZE_BITS = 16
LARGEST = (1 << SIZE_BITS) - 1


def _grams(run: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a run's n-grams, and where each document's begin; fewer words make one gram."""
    sums, size, left = window_sums(run.hashes()), np.diff(run.bounds), run.left()
    short = np.repeat((size < n), size)
    first = np.zeros(len(run), bool)
    first[run.bounds[:-1][size > 0]] = True
    start = np.flatnonzero((left >= n) | (short & first))
    end = np.minimum(start + n, start + left[start])
    return window_hashes(sums, start, end), np.searchsorted(start, run.bounds)


def sketch(documents: DataFrame, n: int) -> np.ndarray:
    """For each of CELLS cells a number from 0 to 255 that rises with its count over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for run in word_runs(batch.column("text"), SPACED, lower=True):
                grams, _ = _grams(run, n)
                total += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            parts = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])
        blocks.tidy(None)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // SLICES, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = documents.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    total = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in counted.collect():  # SLICES rows, 8 * CELLS bytes together
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    z = (total - total.mean()) / max(np.sqrt(total.mean()), 1e-9)
    near = 16 * (np.minimum(z, 4) + 4)  # counts about the mean, in sixteenths of a deviation
    far = 4 * np.log2(np.maximum(z / 4, 1))
    return np.clip(near + far, 0, 255).astype(np.uint8)


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers whose order is the global order of n-grams: by how often their cell is met, then by hash."""
    level = levels[(grams & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(56) | grams >> np.uint64(8)


def prefix_length(size: int, percent: int) -> int:
    return size - (percent * size + 99) // 100 + 1


class Sets:
    """A block's documents as ordered sets; one entry for each distinct set."""

    def __init__(self, table: pa.Table, n: int, percent: int, levels: np.ndarray):
        self.signatures: list[bytes | None] = []
        self.sizes: list[int] = []
        self.sets: dict[bytes, np.ndarray] = {}
        for run in word_runs(table.column("text"), SPACED, lower=True):
            grams, bounds = _grams(run, n)
            keys = ordered(grams, levels)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.sort(keys[a:b])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own
                signature = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if b > a else None
                self.signatures.append(signature)
                self.sizes.append(len(own))
                if signature:
                    self.sets.setdefault(signature, own)
        prefixes = [s[: prefix_length(len(s), percent)] for s in self.sets.values()]
        self.prefix = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
        self.lengths = np.array([len(p) for p in prefixes], np.int64)
        sizes = np.repeat(np.array([min(len(s), LARGEST) for s in self.sets.values()], np.uint64), self.lengths)
        # the low bits of a gram: the top ones only tell the order, and would crowd heavy grams into one bucket
        self.keys, self.at, counts = np.unique(self.prefix << np.uint64(SIZE_BITS) | sizes, return_inverse=True, return_counts=True)
        self.repeated = counts > 1


def _send(buckets: int, n: int, percent: int, levels):
    def send(table: pa.Table) -> pa.Table:
        block = Sets(table, n, percent, levels.value)
        return _requests(table.column("blk")[0].as_py(), blocks.cut_points(block.keys, buckets), keys=block.keys)

    return send


def _fitting(percent: int):
    """Whether another set with the gram has a size that can do; sorted by size, the next one tells."""

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        gram, size = keys[order] >> np.uint64(SIZE_BITS), (keys[order] & np.uint64(LARGEST)).astype(np.int64)
        fits = np.zeros(len(keys) + 1, bool)
        fits[1:-1] = (gram[1:] == gram[:-1]) & ((100 * size[:-1] >= percent * size[1:]) | (size[1:] == LARGEST))
        flags = np.zeros(len(keys), bool)
        flags[order] = fits[:-1] | fits[1:]
        return _flags(table, parts, flags, 0)

    return answer


FOUND = "kind int, doc_id long, sig binary, n int, gram long, pos int, cells binary, grams binary"


def cells_of(grams: np.ndarray) -> bytes:
    """How many grams each of a number of cells has, one cell for about four grams; empty if a count is too large for a byte."""
    size = max(16, 1 << (len(grams) // 4).bit_length())
    counts = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_common(a: bytes, b: bytes) -> float:
    """An upper bound of the grams that two sets share."""
    if not a or not b:
        return float("inf")
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return float(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


def _candidates(buckets: int, n: int, percent: int, levels):
    """Rows of kind 0 (a document), 1 (a shared prefix n-gram of a set), 2 (a set that has some, whole)."""

    def find(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Sets(table, n, percent, levels.value)
        (flags,) = blocks.rows_by_bucket(answers, "flags", kind=0)
        shared = (blocks.bits(flags, _sizes(blocks.cut_points(block.keys, buckets))) | block.repeated)[block.at]
        signatures = list(block.sets)
        sizes = np.array([len(s) for s in block.sets.values()], np.int32)
        owner = np.repeat(np.arange(len(signatures)), block.lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(block.lengths) - block.lengths, block.lengths)
        hit = np.flatnonzero(shared)
        involved = np.unique(owner[hit])
        own = [signatures[i] for i in involved.tolist()]
        kinds = [
            {"kind": 0, "doc_id": table.column("doc_id").combine_chunks(), "sig": pa.array(block.signatures, pa.binary()), "n": pa.array(block.sizes, pa.int32())},
            {"kind": 1, "sig": pa.array([signatures[i] for i in owner[hit].tolist()], pa.binary()), "n": pa.array(sizes[owner[hit]], pa.int32()), "gram": pa.array(block.prefix[hit].view(np.int64)), "pos": pa.array(place[hit].astype(np.int32))},
            {"kind": 2, "sig": pa.array(own, pa.binary()), "n": pa.array(sizes[involved], pa.int32()), "cells": pa.array([cells_of(block.sets[x]) for x in own], pa.binary()), "grams": pa.array([block.sets[x].tobytes() for x in own], pa.binary())},
        ]
        return pa.concat_tables([_filled(x) for x in kinds])

    return find


_TYPES = {"kind": pa.int32(), "doc_id": pa.int64(), "sig": pa.binary(), "n": pa.int32(), "gram": pa.int64(), "pos": pa.int32(), "cells": pa.binary(), "grams": pa.binary()}


def _filled(columns: dict) -> pa.Table:
    rows = len(columns["sig"])
    columns = columns | {"kind": pa.array([columns["kind"]] * rows, pa.int32())}
    return pa.table({k: columns.get(k, pa.nulls(rows, t)) for k, t in _TYPES.items()})


class PrefixTree:
    """Ordered sets as a path-compressed trie: sorted, with the length of each common path."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.common = np.array([_common(a, b) for a, b in zip(self.sets[:-1], self.sets[1:], strict=True)], np.int64)

    def walk(self, probe: np.ndarray, percent: int) -> list[int]:
        """The sets (by their place in the list given) that are alike enough to ``probe``."""
        out: list[int] = []
        size = len(probe)
        stack = [(0, len(self.sets), 0, 0)] if self.sets else []
        while stack:
            low, high, depth, overlap = stack.pop()
            inner = self.common[low : high - 1]
            to = int(inner.min()) if len(inner) else int(self.sizes[low])
            path = self.sets[low][depth:to]
            used = 0
            if len(path):
                at = np.searchsorted(probe, path)
                used = int(np.searchsorted(probe, path[-1], "right"))
                at[at == size] = size - 1
                overlap += int(np.count_nonzero(probe[at] == path))
            rest = self.sizes[low:high]
            # the most that any set below can still reach: its own rest, or the probe's
            reach = overlap + np.minimum(rest - to, size - used)
            able = reach * (100 + percent) >= percent * (rest + size)
            if not able.any():
                continue
            if high - low == 1:
                out.append(self.order[low])
                continue
            edges = [low, *(np.flatnonzero(inner == to) + low + 1).tolist(), high]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a == 1 and self.sizes[a] == to:  # the path ends here
                    if overlap * (100 + percent) >= percent * (to + size):
                        out.append(self.order[a])
                elif able[a - low : b - low].any():
                    stack.append((a, b, to, overlap))
        return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Forest:
    """Links that join components, among sets of which each tree member shares an n-gram with each probe.

    ``after`` are the sets' n-grams behind that one; ``sizes`` are of the whole sets.
    """

    def __init__(self, after: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, tree: np.ndarray, probes: np.ndarray, percent: int):
        self.percent, self.labels = percent, np.unique(labels, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        lengths = np.array([len(a) for a in after])
        grams, flat = np.unique(np.concatenate(after), return_inverse=True)
        ends = np.cumsum(lengths)
        numbers = [flat[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        self.tree = np.array(sorted(tree.tolist(), key=lambda k: numbers[k].astype(">u4").tobytes()))
        self.sets = [numbers[k] for k in self.tree]
        self.lengths, self.sizes = lengths[self.tree], sizes[self.tree]
        self.common = np.array([_common(a, b) for a, b in zip(self.sets[:-1], self.sets[1:], strict=True)], np.int64)
        self.probes, self.probe_sizes, self.probe_lengths = probes, sizes[probes], lengths[probes]
        self.width = len(grams) + 1
        held = [numbers[k] for k in probes]
        owner = np.repeat(np.arange(len(probes)), self.probe_lengths)
        every = np.concatenate(held)
        self.keys = owner * self.width + every  # sorted: a probe's n-grams, in order
        self.first = np.cumsum(self.probe_lengths) - self.probe_lengths
        order = np.argsort(every, kind="stable")
        self.having, self.at = owner[order], np.searchsorted(every[order], np.arange(self.width + 1))

    def grown(self) -> list[tuple[int, int]]:
        every = np.arange(len(self.probes))
        # members low..high share the first ``depth`` n-grams; overlap and n-grams used up, of each active probe
        stack = [(0, len(self.sets), 0, every, np.ones(len(every), np.int64), np.zeros(len(every), np.int64))]
        while stack:
            low, high, depth, active, overlap, used = stack.pop()
            inner = self.common[low : high - 1]
            to = int(inner.min()) if len(inner) else int(self.lengths[low])
            own = np.unique(self.labels[self.tree[low:high]])
            if len(own) == 1:
                other = self.labels[self.probes[active]] != own[0]
                active, overlap, used = active[other], overlap[other], used[other]
            if len(active) and to > depth:
                path = self.sets[low][depth:to]
                spans = [self.having[self.at[g] : self.at[g + 1]] for g in path.tolist()]
                overlap = overlap + np.bincount(np.concatenate(spans), minlength=len(self.probes))[active]
                used = np.searchsorted(self.keys, active * self.width + path[-1], "right") - self.first[active]
            reach = overlap + np.minimum(int(self.lengths[low:high].max()) - to, self.probe_lengths[active] - used)
            able = self._enough(reach, int(self.sizes[low:high].min()), active)
            if not able.any():
                continue
            active, overlap, used = active[able], overlap[able], used[able]
            edges = [low, *(np.flatnonzero(inner == to) + low + 1).tolist(), high] if len(inner) else [low, high]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a == 1 and self.lengths[a] == to:  # the path ends here
                    self._link(a, active[self._enough(overlap, int(self.sizes[a]), active)])
                else:
                    stack.append((a, b, to, active, overlap, used))
        return self.links

    def _enough(self, overlap: np.ndarray, size: int, active: np.ndarray) -> np.ndarray:
        return overlap * (100 + self.percent) >= self.percent * (size + self.probe_sizes[active])

    def _link(self, member: int, alike: np.ndarray) -> None:
        m = self.tree[member]
        for p in self.probes[alike].tolist():
            if self.labels[p] != self.labels[m]:
                self.links.append((int(m), p))
                self.labels[self.labels == self.labels[p]] = self.labels[m]


def _side_by_side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by n-gram and chunks, each from the least set to the largest, and where each ends."""
    key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("gram", "i", "j", "n")])
    order = np.lexsort(key[::-1])
    key = key[:3, order]
    return order, np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, len(order))


def _promising(table: pa.Table, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which of the rows (of some n-grams' chunks) have a partner that could reach the threshold: of another
    component, of a fitting size, with enough left behind the n-gram, and enough cells in common. Of n-grams
    with few rows the pairs themselves."""
    n, left = table.column("n").to_numpy().astype(np.int64), table.column("n").to_numpy() - table.column("pos").to_numpy()
    labels = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)[1]
    chunk, i, j = (table.column(c).to_numpy() for c in ("chunk", "i", "j"))
    cells = table.column("cells").to_pylist()
    order, ends = _side_by_side(table)
    able, pairs = np.zeros(len(order), bool), []
    begin = 0
    for end in ends.tolist():
        own = order[begin:end]
        begin = end
        if len(own) < 2 or (labels[own] == labels[own[0]]).all():
            continue
        size, rest = n[own], left[own]
        high = np.searchsorted(100 * size, 10000 * size // percent, "right")  # sizes that fit, rounded up
        for k in range(len(own) - 1):
            m = own[k]
            others = own[k + 1 : high[k]]
            ok = (labels[others] != labels[m]) & ((chunk[others] != chunk[m]) | (i[m] == j[m]))
            ok &= np.minimum(rest[k + 1 : high[k]], rest[k]) * (100 + percent) >= percent * (size[k + 1 : high[k]] + size[k])
            if len(own) > FEW:
                ok &= ~(able[others] & able[m])
            others = others[ok]
            if not len(others):
                continue
            good = np.ones(len(others), bool)
            if cells[m]:
                mine = np.frombuffer(cells[m], np.uint8)
                for t, o in enumerate(others.tolist()):
                    if cells[o]:
                        theirs = np.frombuffer(cells[o], np.uint8).reshape(-1, len(mine)).sum(0, dtype=np.int64)
                        good[t] = np.minimum(mine, theirs).sum() * (100 + percent) >= percent * (n[m] + n[o])
            if len(own) > FEW:
                able[others[good]] = True
                able[m] |= good.any()
            else:
                pairs += [(int(m), o) for o in others[good].tolist()]
    return able, pairs


#: Classes up to which their names (40 bytes each) are broadcast to find their sets.
NAMED = 1 << 19


def _sets_of(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, grams) of these classes (sig). Few names go to the sets, so that no other set is shuffled; many are joined."""
    names = classes.distinct()
    names = F.broadcast(names) if names.limit(NAMED + 1).count() <= NAMED else names
    whole = found.where("kind = 2").select("sig", "grams").join(names, "sig", "left_semi")
    return whole.groupBy("sig").agg(F.first("grams").alias("grams"))  # a class stands once for each block that has it


def _joined(rest: DataFrame, found: DataFrame, cells: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components, of ``rest`` (gram, sig, n, pos, label); a forest for each n-gram."""

    def promising(table: pa.Table) -> pa.Table:
        able, pairs = _promising(table, percent)
        rows = table.filter(pa.array(able)).select(["gram", "i", "j", "chunk", "sig", "n", "pos", "label"])
        sigs = table.column("sig").to_pylist()
        named = sorted({(sigs[a], sigs[b]) if sigs[a] < sigs[b] else (sigs[b], sigs[a]) for a, b in pairs})
        ends = pa.table({"a": pa.array([a for a, _ in named], pa.binary()), "b": pa.array([b for _, b in named], pa.binary())})
        return pa.concat_tables([rows, ends], promote_options="default").select([*rows.column_names, "a", "b"])

    def grow(table: pa.Table) -> pa.Table:
        order, ends = _side_by_side(table)
        chunk, n = table.column("chunk").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        one, two = table.column("i").to_numpy(), table.column("j").to_numpy()
        labels = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)[1]
        ids, after = table.column("sig").to_pylist(), table.column("after").combine_chunks()
        found: list[tuple[int, int]] = []
        begin = 0
        for end in ends.tolist():
            own = order[begin:end]
            begin = end
            tree, probes = np.flatnonzero(chunk[own] == one[own[0]]), np.flatnonzero(chunk[own] == two[own[0]])
            if len(tree) and len(probes) and (labels[own] != labels[own[0]]).any():
                sets = [np.frombuffer(after[k].as_buffer(), np.uint64) for k in own.tolist()]
                found += [(own[a], own[b]) for a, b in Forest(sets, n[own], labels[own], tree, probes, percent).grown()]
        return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.binary()), "b": pa.array([ids[b] for _, b in found], pa.binary())})

    # so many chunks that neither the sets of one nor their bytes are too many for a task
    chunks = rest.groupBy("gram").agg((F.floor(F.greatest(F.count("*") / GROUP, F.sum("n") * 8 / GROUP_BYTES)) + 1).cast("int").alias("chunks"))
    dealt = rest.join(chunks, "gram").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    dealt = dealt.join(cells, "sig").select("gram", "i", "j", "chunk", "sig", "n", "pos", "label", "cells")
    # a call takes the chunks of some n-grams, which are small
    calls = 8 * partitions(rest.sparkSession)
    dealt = dealt.withColumn("call", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(calls)))
    some = dealt.groupBy("call").applyInArrow(promising, "gram long, i int, j int, chunk int, sig binary, n int, pos int, label binary, a binary, b binary")
    some = scratch.write("promising", some)
    pairs = some.where("a is not null").select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).unionByName(some.where("sig is not null").select("sig"))
    sets = scratch.write("ends", _sets_of(ends, found))
    few = _verified(pairs, sets, percent)
    whole = some.where("a is null").drop("a", "b").withColumn("call", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(calls))).join(sets, "sig").withColumn("after", F.expr("substring(grams, 8 * pos + 9)"))
    return whole.select("call", "gram", "i", "j", "chunk", "sig", "n", "label", "after").groupBy("call").applyInArrow(grow, "a binary, b binary").unionByName(few).distinct()


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the distinct candidate edges (a, b), those whose sets are alike enough; a leads."""

    def verify(table: pa.Table) -> pa.Table:
        leads = table.column("lead").to_numpy()
        if not leads.any():
            return _NO_EDGES
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        ids = table.column("b").to_pylist()
        lead = int(np.flatnonzero(leads)[0])
        members = np.flatnonzero(~leads).tolist()
        found = PrefixTree([grams[i] for i in members]).walk(grams[lead], percent)
        b = [ids[members[i]] for i in found]
        return pa.table({"a": pa.array([ids[lead]] * len(b), pa.binary()), "b": pa.array(b, pa.binary())})

    sizes = edges.groupBy("a").agg((F.floor(F.count("*") / CHUNK) + 1).cast("int").alias("chunks"))
    members = edges.join(sizes, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")).drop("chunks")
    leads = sizes.select("a", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    members = members.join(sets, members.b == sets.sig).select("a", "chunk", "b", F.lit(False).alias("lead"), "grams")
    leads = leads.join(sets, leads.a == sets.sig).select("a", "chunk", F.col("a").alias("b"), F.lit(True).alias("lead"), "grams")
    both = members.unionByName(leads)
    return both.groupBy("a", "chunk").applyInArrow(verify, "a binary, b binary")


_NO_EDGES = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each end of an edge: the least node of its component.

    Labels pass to neighbours and then jump to their label's label, so long chains take a number of
    rounds that grows with the logarithm of their length. Only a count reaches the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = scratch.write(f"{name}-both", both.distinct())
    labels = both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label"))

    def step(labels: DataFrame) -> DataFrame:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        passed = labels.join(near, "node").select(*[c for c in labels.columns if c != "label"], F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = passed.join(far, "label", "left")
        return jumped.select(*[c for c in labels.columns if c != "label"], F.least("label", F.coalesce("far", "label")).alias("label"))

    for k in range(200):
        after = scratch.write(f"{name}-{k}", step(labels.withColumn("old", F.col("label"))))
        if k:
            scratch.drop(f"{name}-{k - 1}")
        if not after.where("label != old").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")
    raise RuntimeError("labels did not settle")


def _able(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, m, b, n) whose cell counts allow the threshold."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("m", "n", "x", "y")]
            able = [most_common(x, y) * (100 + percent) >= percent * (m + n) for m, n, x, y in zip(*columns, strict=True)]
            yield batch.filter(pa.array(able, pa.bool_())).select(["a", "b"])

    one = cells.select(F.col("sig").alias("a"), F.col("cells").alias("x"))
    two = cells.select(F.col("sig").alias("b"), F.col("cells").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(bound, "a binary, b binary")


def classes(documents: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig, n) of every document, and (node, label) of the sets that are linked to others."""
    spark = documents.sparkSession
    buckets = partitions(spark)
    texts = need(documents, doc_id="long", text="string")
    levels = spark.sparkContext.broadcast(sketch(texts, n))
    dealt = blocks.dealt(texts)
    asked = blocks.ask(dealt, _send(buckets, n, percent, levels), "bucket int, blk int, keys binary")
    shared = scratch.write("shared", blocks.answer(asked, _fitting(percent), "blk int, bucket int, kind int, flags binary"), large=True)
    found = scratch.write("found", blocks.resume(dealt, shared, _candidates(buckets, n, percent, levels), FOUND), large=True)
    scratch.drop("shared")
    documents = found.where("kind = 0").select("doc_id", "sig", "n")
    cells = found.where("kind = 2").groupBy("sig").agg(F.first("cells").alias("cells"))
    tokens = found.where("kind = 1").groupBy("gram", "sig").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    tokens = scratch.write("tokens", tokens)
    step = float(np.log(100 / percent))
    # sizes in ranges, once more by half a range further: a group of copies is whole in one or the other
    ranges = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.floor(F.ln("n") / step + h / 2).alias("size")) for h in range(2)]))
    near = tokens.withColumn("r", ranges).select("gram", "sig", "n", F.col("r.h").alias("h"), F.col("r.size").alias("size"))
    star = F.struct(F.xxhash64("sig", F.col("h"), F.pmod("gram", F.lit(2))).alias("z"), "sig", "n")
    lead = near.groupBy("gram", "h", "size").agg(F.min(star).alias("lead"), F.max("sig").alias("x"), F.min("sig").alias("y")).where("x != y").drop("x", "y")
    pairs = near.join(lead, ["gram", "h", "size"]).select(F.col("lead.sig").alias("a"), F.col("lead.n").alias("m"), F.col("sig").alias("b"), "n").where("a != b")
    pairs = pairs.where(f"100 * least(n, m) >= {percent} * greatest(n, m)").groupBy("a", "m", "b", "n").agg(F.count("*").alias("grams"))
    best = Window.partitionBy("b").orderBy(F.desc("grams"), F.xxhash64("a"), "a")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LEADERS).drop("grams", "rank")
    pairs = scratch.write("pairs", _able(pairs, cells, percent))
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    sets = scratch.write("sets", _sets_of(ends, found))
    links = scratch.write("links", _verified(pairs, sets, percent))
    scratch.drop("sets")
    labels = connected(links, scratch, "stars")
    rest = scratch.write("rest", _unsettled(tokens, labels))
    more = scratch.write("joined", _joined(rest, found, cells, percent, scratch))
    if more.limit(1).count():
        labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), scratch, "joined-labels")
    scratch.drop("tokens", "pairs", "links", "rest", "promising", "ends", "joined")
    return documents, labels


def _unsettled(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens, with labels, of the grams whose classes are in different components."""
    named = tokens.join(labels, tokens.sig == labels.node, "left").select("gram", "sig", "n", "pos", F.coalesce("label", "sig").alias("label"))
    open_ = named.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("gram")
    return named.join(open_, "gram")


def components(documents: DataFrame, n: int = 3, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    The set of a text is that of its distinct n-grams of lower-cased words; fewer words make one
    gram. Texts with 100 * |intersection| >= percent * |union| are linked; ``component_id`` is the
    least doc_id that links reach. Null and wordless texts have empty sets and are linked to nothing.
    Rows with a null doc_id link like others but lend no id: a component of such rows alone has null.
    Rows that share a doc_id are judged each by its own text.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    docs, labels = classes(documents, n, percent, scratch)
    named = docs.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"))
    named = named.join(labels, named.sig == labels.node, "left").select("sig", "first", F.coalesce("label", "sig").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select(F.col("sig").alias("own"), "component_id")
    out = docs.join(named, docs.sig == named.own, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; columns unchanged.

    Rows with a null doc_id stay. Where rows share a doc_id, equal ones among the kept are one.
    """
    scratch = Scratch(documents.sparkSession)
    found = scratch.write("components", components(documents, n, percent, scratch))
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    whole = documents.where("doc_id is not null")
    out = whole.join(kept, whole["doc_id"] == kept["__kept"], "left_semi")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates()
    return out.unionByName(documents.where("doc_id is null"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    return components(docs)
