"""Packing documents into sequences of equal length by first-fit decreasing.

Every document is tokenized and ended by ``END_ID``. Whole sequences are cut off its front; what is
left over, under one sequence, goes to a randomised group of about ``GROUP`` others, which packs by
itself: pieces in falling order of length, each into the first sequence with room, found by a
tournament tree of the room that sequences have left. Pieces are then cut as rarely as closing the
sequences allows: a gap of more than ``SLACK`` ids is filled from the emptiest sequence, and the last
one is cut at powers of two, which need no padding.

Scale: a text is read once, by a task that emits whole sequences at once and rests of two bytes an id;
the rests are the one thing that is shuffled, by a hash of where they stand in the written table, so
no source, repeated row or id gathers in a group. A group holds ``GROUP`` rests of under one sequence
each, whatever the documents are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids
from .common import Scratch, need
from .text import mix

LENGTH, END_ID = 2048, 1
GROUP, SLACK = 2048, 16
#: Whole sequences are numbered by task from here on, those of groups below.
WHOLE = 1 << 62


class Tournament:
    """Room left of sequences 0, 1, ...: each inner node holds the most room below it."""

    def __init__(self, leaves: int, room: int):
        self.first = 1 << max(0, leaves - 1).bit_length()
        self.most = [room] * (2 * self.first)

    def seat(self, size: int) -> int:
        """The first sequence with ``size`` left, which then has so much less."""
        most, k = self.most, 1
        while k < self.first:
            k *= 2
            if most[k] < size:
                k += 1
        seat = k - self.first
        most[k] -= size
        while k > 1:
            k //= 2
            best = max(most[2 * k], most[2 * k + 1])
            if most[k] == best:
                break
            most[k] = best
        return seat


def first_fit_decreasing(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Sequences as lists of places in ``sizes``; none of which may be over ``length``. Ties keep their order."""
    tree = Tournament(len(sizes), length)
    out: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        seat = tree.seat(sizes[k])
        if seat == len(out):
            out.append([])
        out[seat].append(k)
    return out


def closed(sequences: list[list[tuple[int, int, int]]], length: int = LENGTH, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, size) with gaps of more than ``slack`` filled from the emptiest ones.

    At most one sequence stays open then; it is cut at powers of two, the greatest first.
    """
    full = lambda s: sum(p[2] for p in s)
    done = [s for s in sequences if length - full(s) <= slack]
    gaps = sorted((s for s in sequences if length - full(s) > slack), key=full)  # the emptiest are first
    low, high = 0, len(gaps) - 1
    while low < high:
        target, gap = gaps[high], length - full(gaps[high])
        while gap and low < high:
            doc, start, size = gaps[low].pop()
            take = min(size, gap)
            target.append((doc, start, take))
            if take < size:
                gaps[low].append((doc, start + take, size - take))
            gap -= take
            if not gaps[low]:
                low += 1
        if low < high:
            done.append(target)
            high -= 1
    last = [p for p in gaps[low]] if gaps else []
    left = full(last)
    if left == length or length - left <= slack:
        return [*done, last] if last else done
    while left:
        room = 1 << left.bit_length() - 1
        own = []
        left -= room
        while room:
            doc, start, size = last.pop(0)
            take = min(size, room)
            own.append((doc, start, take))
            if take < size:
                last.insert(0, (doc, start + take, size - take))
            room -= take
        done.append(own)
    return done


_TOKENIZED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("wide", pa.bool_()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("key", pa.int64())])
_RESULT = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.list_(pa.int32()))])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenizing(tokenizer: str | None, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids.ready(tokenizer, end_id)
        wide = tokens.width.itemsize > 2
        task = TaskContext.get().partitionId()
        rest = whole = 0
        for batch in batches:
            out: list[list] = [[] for _ in _TOKENIZED]
            texts = batch.column("text").fill_null("").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.ids(texts), strict=True):
                for start in range(0, len(ids), length):
                    own = ids[start : start + length]
                    row = [doc, start, len(own), len(ids), own.tobytes(), wide]
                    if len(own) == length:
                        row += [crc(own), WHOLE | task << 40 | whole, None]
                        row[4] = row[4] if with_ids else None
                        whole += 1
                    else:
                        row += [None, None, task << 40 | rest]
                        rest += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            keys = [None if k is None else int(mix(np.array([k + 1], np.uint64)).view(np.int64)[0]) for k in out[-1]]
            yield pa.record_batch([*map(pa.array, out[:-1], _TOKENIZED.types[:-1]), pa.array(keys, pa.int64())], schema=_TOKENIZED)

    return run


def _packing(length: int, slack: int, with_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")])  # the order that they were drawn in
        group = table.column("grp")[0].as_py()
        doc, start, size, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens"))
        kind = "<u4" if table.column("wide")[0].as_py() else "<u2"
        ids = table.column("ids")
        out: list[list] = [[] for _ in _RESULT]
        packed = [[(k, 0, size[k]) for k in s] for s in first_fit_decreasing(size, length)]
        for n, sequence in enumerate(closed(packed, length, slack)):
            offset = 0
            for k, at, n_ids in sequence:
                own = np.frombuffer(ids[k].as_buffer(), kind)[at : at + n_ids]
                for column, value in zip(out, (doc[k], start[k] + at, n_ids, crc(own), total[k], group << 24 | n, offset, own.astype(np.int32) if with_ids else None), strict=True):
                    column.append(value)
                offset += n_ids
        return pa.table([pa.array(c, t) for c, t in zip(out, _RESULT.types, strict=True)], schema=_RESULT)

    return run


def _whole(with_ids: bool):
    """Whole sequences as rows of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(c) for c in _RESULT.names[:-1]]
            if with_ids:
                wide = batch.column("wide").to_pylist()
                ids = [np.frombuffer(i.as_buffer(), "<u4" if w else "<u2").astype(np.int32) for i, w in zip(batch.column("ids"), wide, strict=True)]
            else:
                ids = [None] * batch.num_rows
            yield pa.record_batch([*out, pa.array(ids, _RESULT.types[-1])], schema=_RESULT)

    return run


def pack(documents: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, group: int = GROUP, slack: int = SLACK, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ``ids``.

    ``documents`` has doc_id and text; other columns are left alone, missing ones count as null. A null or
    empty text is its end id alone. Equal rows are documents by themselves, and so are rows that share an id
    or have none. An empty table gives no rows. Sequences are of at most ``length``, a power of two.
    ``tokenizer`` is a file of the library tokenizers that every machine has.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")
    spark = documents.sparkSession
    docs = need(documents, doc_id="long", text="string")
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, wide boolean, ids_crc32 long, sequence_id long, key long"
    table = Scratch(spark).write("tokenized", docs.mapInArrow(_tokenizing(tokenizer, end_id, length, with_ids), schema))
    rests = table.where("key is not null")
    groups = max(1, rests.count() // group)
    packed = rests.withColumn("grp", F.pmod("key", F.lit(groups))).drop("sequence_id", "ids_crc32")
    packed = packed.groupBy("grp").applyInArrow(_packing(length, slack, with_ids), _PIECES)
    whole = table.where("key is null").drop("key").withColumn("offset", F.lit(0).cast("long"))
    return whole.mapInArrow(_whole(with_ids), _PIECES).unionByName(packed)


def op11(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
