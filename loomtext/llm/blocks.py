"""Blocks of documents that ask sorted buckets about packed keys.

Documents are dealt to blocks by a hash of their id, or of their text where they have none, so that
rows without ids, of which there may be many, are spread like others. A block sends each of its distinct keys once,
sorted and packed, to the bucket that owns the key's range; the bucket answers in the same order.
So a key that a third of all documents hold reaches its bucket once for each block, not once for
each document, and what moves is a few bytes a key instead of a row. Blocks and buckets are as many
as the session's shuffle partitions say (four blocks and one bucket for each); set those so that a
partition has some tens of MB of text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

#: Blocks for each shuffle partition.
PER_PARTITION = 4


def _block(doc_id: Column, text: Column, spark: SparkSession) -> Column:
    key = F.when(doc_id.isNull(), F.xxhash64(text.cast("string"))).otherwise(F.xxhash64(doc_id.cast("long")))
    return F.pmod(key, F.lit(PER_PARTITION * partitions(spark))).cast("int")


def dealt(documents: DataFrame) -> DataFrame:
    """``documents`` with the number of their block in ``blk``; equal ids share a block, as do equal texts without id."""
    return documents.withColumn("blk", _block(F.col("doc_id"), F.col("text"), documents.sparkSession))


def dealt_rows(documents: DataFrame, **more: Column) -> DataFrame:
    """The block of each row and the row as one column, ``row``; texts are held once. ``more`` by name."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])
    return rows.withColumn("blk", _block(F.col("row.doc_id"), F.col("row.text"), documents.sparkSession))


def opened(table: pa.Table) -> pa.Table:
    """A block of ``dealt_rows`` with doc_id and text as columns."""
    row = table.column("row").combine_chunks()
    fields = {f.name.lower(): f.name for f in row.type}
    ids = pc.cast(pc.struct_field(row, fields["doc_id"]), pa.int64())
    return table.append_column("doc_id", pa.chunked_array([ids])).append_column("text", pa.chunked_array([pc.cast(pc.struct_field(row, fields["text"]), pa.string())]))


def cut_points(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one bucket's range to the next; buckets + 1 points."""
    step = (1 << 64) // buckets + 1
    edges = np.array([min(step * b, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def pack(values: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of 64-bit values as a byte matrix."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def unpack(data: bytes, size: int) -> np.ndarray:
    full = np.zeros((len(data) // size, 8), np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return full.view("<u8").ravel()


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def tidy(out: pa.Table) -> pa.Table:
    """Gives memory that a block has freed back to the system, so that idle workers hold none of it."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    return out


def ask(groups: DataFrame, fn: Callable, schema: str) -> DataFrame:
    def of_block(table: pa.Table) -> pa.Table:
        return tidy(fn(table))

    return groups.groupBy("blk").applyInArrow(of_block, schema)


def answer(requests: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` over all the requests of one bucket."""

    def of_bucket(table: pa.Table) -> pa.Table:
        return tidy(fn(table))

    return requests.groupBy("bucket").applyInArrow(of_bucket, schema)


def resume(blocks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``fn`` over each block and the answers to it."""

    def of_block(table: pa.Table, own: pa.Table) -> pa.Table:
        return tidy(fn(table, own))

    return blocks.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(of_block, schema)


def rows_by_bucket(answers: pa.Table, *columns: str, kind: int | None = None) -> list[list[bytes]]:
    """Columns of a block's answers in the order of their buckets."""
    if kind is not None and answers.num_rows:
        answers = answers.filter(pc.equal(answers.column("kind"), kind))
    order = np.argsort(answers.column("bucket").to_numpy()) if answers.num_rows else []
    taken = answers.take(pa.array(order, pa.int64()))
    return [taken.column(c).to_pylist() for c in columns]


def bits(parts: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Flags that were packed bucket by bucket, as one array."""
    out = [np.unpackbits(np.frombuffer(p, np.uint8), count=int(c)) for p, c in zip(parts, counts, strict=True)]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)
