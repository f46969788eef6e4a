"""Vector code compression: each quarter of a vector as the number of its nearest codebook entry.

Components are integers in units of 1/``SCALE``, so every distance, sum and mean is exact and no order
of rows or tasks changes a result. A round is one pass over the vectors: tasks compare whole Arrow
batches with the broadcast codebooks by norm expansion, |x|^2 - 2xc + |c|^2, as integer matrix
products, take the first least entry, and add up their parts; the sums (one row for each part, entry
and task) are merged by a grouped shuffle. Vectors are never shuffled; codebooks are ``ENTRIES``
times the width of a vector in size, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries are held at once.
ROWS = 2048


@dataclass
class Codebooks:
    """``entries[p]``: the int64 entries of part p, in order, as rows. Vectors of another ``dims`` aren't coded."""

    entries: list[np.ndarray]
    dims: int
    scale: int = SCALE

    @property
    def padded(self) -> int:
        return -(-self.dims // len(self.entries)) * len(self.entries)

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for row in e.tolist() for x in row).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes by part, summed squared distance) of integer vectors."""
        width = self.padded // len(self.entries)
        codes, error = np.empty((len(vectors), len(self.entries)), np.int64), np.zeros(len(vectors), np.int64)
        for p, entries in enumerate(self.entries):
            across = np.ascontiguousarray(-2 * entries.T)
            norms = (entries * entries).sum(axis=1)
            for at in range(0, len(vectors), ROWS):
                x = vectors[at : at + ROWS, p * width : (p + 1) * width]
                far = x @ across
                far += norms
                own = far.argmin(axis=1)
                codes[at : at + ROWS, p] = own
                error[at : at + ROWS] += (x * x).sum(axis=1) + far[np.arange(len(x)), own]
        return codes, error

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], axis=1)[:, : self.dims] / self.scale


def _sound(vector: Column, dims: int | None = None) -> Column:
    """Neither null nor empty, of ``dims`` components, all of them finite numbers."""
    of_size = F.size(vector) > 0 if dims is None else F.size(vector) == dims
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(of_size & finite, F.lit(False))


def integers(vectors: pa.Array, dims: int, padded: int, scale: int = SCALE) -> np.ndarray:
    """Sound vectors as rows of floor(scale * x), filled with 0 to ``padded`` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), padded), np.int64)
    out[:, :dims] = np.floor(scale * flat).astype(np.int64).reshape(len(vectors), dims)
    return out


def _merged(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sum of each part's entries over all of a task's vectors."""
    width = books.padded // len(books.entries)
    sums = [np.zeros((len(e), width), np.int64) for e in books.entries]
    counts = [np.zeros(len(e), np.int64) for e in books.entries]
    for batch in batches:
        vectors = integers(batch.column("vector"), books.dims, books.padded, books.scale)
        codes, _ = books.nearest(vectors)
        for p in range(len(books.entries)):
            order = np.argsort(codes[:, p], kind="stable")
            own, begin, size = np.unique(codes[order, p], return_index=True, return_counts=True)
            if len(own):
                sums[p][own] += np.add.reduceat(vectors[order, p * width : (p + 1) * width], begin, axis=0)
                counts[p][own] += size
    part = np.repeat(np.arange(len(sums)), [len(c) for c in counts])
    entry, count, total = np.concatenate([np.arange(len(c)) for c in counts]), np.concatenate(counts), np.concatenate(sums)
    met = count > 0
    rows = pa.array(list(total[met]), pa.list_(pa.int64()))
    yield pa.record_batch([pa.array(part[met], pa.int32()), pa.array(entry[met], pa.int32()), pa.array(count[met], pa.int64()), rows], names=["part", "entry", "count", "sums"])


def _round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry as the mean, rounded down, of the parts that are nearest to it; others stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width = books.padded // len(books.entries)
    each = vectors.mapInArrow(lambda batches: _merged(batches, shared.value), "part int, entry int, count long, sums array<bigint>")
    # decimals, as sums over all tasks may pass 64 bits
    of = lambda k: F.sum(F.get("sums", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}")
    rows = each.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[of(k) for k in range(width)]).collect()  # as many as the codebooks have entries
    entries = [e.copy() for e in books.entries]
    for r in rows:
        entries[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["count"] for k in range(width)]
    shared.unpersist()
    return Codebooks(entries, books.dims, books.scale)


def _first(vectors: DataFrame, dims: int, parts: int, entries: int, scale: int) -> Codebooks:
    """The vectors of the least distinct ids; of an id that several vectors share, the least vector."""
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    last = next((r["vec_id"] for r in reversed(ids) if r["vec_id"] is not None), None)
    near = F.lit(False) if last is None else F.col("vec_id") <= last
    near = near | F.col("vec_id").isNull() if any(r["vec_id"] is None for r in ids) else near
    rows = vectors.where(near).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    books = Codebooks([np.zeros((0, 0), np.int64)] * parts, dims, scale)
    table = rows.select("vector").toArrow()  # at most ``entries`` rows
    whole = integers(table.column("vector").combine_chunks(), dims, books.padded, scale)
    return Codebooks([np.ascontiguousarray(p) for p in np.split(whole, parts, axis=1)], dims, scale)


def sound(vectors: DataFrame, dims: int | None = None) -> tuple[DataFrame, int]:
    """(row, vec_id, vector) of the vectors that are neither null nor hold null or non-finite components, and their size.

    ``dims`` is the size that most of them have unless it is given, the greater of several; others are dropped.
    """
    have = {c.lower() for c in vectors.columns}
    col = lambda c: F.col(f"row.`{c}`") if c in have else F.lit(None)
    kind = dict((c.lower(), t) for c, t in vectors.dtypes).get("embedding", "array<float>")
    kept = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"))
    kept = kept.select("row", col("vec_id").cast("long").alias("vec_id"), col("embedding").cast(kind if kind == "array<double>" else "array<float>").alias("vector"))
    if dims is None:
        sizes = kept.where(_sound(F.col("vector"))).groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
        dims = sizes[0]["dims"] if sizes else 0
    return kept.where(_sound(F.col("vector"), dims)) if dims else kept.where("false"), dims


def fit(kept: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of sound vectors (vec_id, vector).

    Components so large that a distance could pass 64 bits are an error, not a wrong code.
    """
    most = kept.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double"))))).first()[0] or 0.0
    if -(-dims // parts) * parts * (2.0 * (scale * most + 1)) ** 2 >= 2.0**62:
        raise ValueError(f"a component of {most} is too large for exact 64-bit distances")
    books = _first(kept, dims, parts, entries, scale)
    for _ in range(rounds):
        books = _round(kept, books)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, ...) all columns of ``kept`` but the vector, with ``code``, two hex digits a part (more where there
    are over 256 entries), and ``error``, the summed squared distance in units of 1/scale^2."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    rest = [c for c in kept.columns if c != "vector"]
    digits = max(2, -(-(len(books.entries[0]) - 1).bit_length() // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            codes, error = own.nearest(integers(batch.column("vector"), own.dims, own.padded, own.scale))
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=[*rest, "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", code string, error long")


def decode(codes: pa.Array, books: Codebooks) -> np.ndarray:
    """Vectors of an Arrow array of codes."""
    texts = codes.to_pylist()
    digits = len(texts[0]) // len(books.entries) if texts else 2
    numbers = [[int(t[k : k + digits], 16) for k in range(0, len(t), digits)] for t in texts]
    return books.decoded(np.array(numbers, np.int64).reshape(len(texts), len(books.entries)))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int | None = None) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every sound vector; see ``op13``.

    ``vectors`` has vec_id, embedding and label; other columns are left alone, missing ones count as null.
    A vector that is null, empty or of another size than most, or holds null or non-finite components, is
    dropped. Sizes that ``parts`` doesn't divide are filled with zeros. Equal rows are coded alike; rows that
    share an id count as one where codebooks begin, the null id as the last one; with fewer ids than
    ``entries`` codebooks are so much shorter. No sound vectors give no rows.
    """
    spark = vectors.sparkSession
    kept, dims = sound(vectors, dims)
    kind = {c.lower(): t for c, t in vectors.dtypes}.get("label")
    if not dims:
        return spark.createDataFrame([], f"vec_id long, label {kind or 'long'}, code string, error long, label_error long, codebooks_sha256 string")
    label = (F.col("row.label") if kind else F.lit(None).cast("long")).alias("label")
    kept = kept.select("vec_id", "vector", label)
    books = fit(kept, dims, parts, entries, rounds, scale)
    coded = Scratch(spark).write("coded", encode(kept, books))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("__label"), "label_error")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The same rows by DuckDB, for vectors of 64 components and integer sums that fit."""
    rounds = ""
    nearest = """a{k} as (select vec_id, label, part, v, min(list_sum(list_transform(range(1, 17), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint * 256 + entry) as best from p join b{k} using (part) group by all)"""
    for k in range(ROUNDS):
        rounds += nearest.format(k=k) + f""",
s{k} as (select part, best % 256 as entry, i, sum(v[i])::bigint as s, count(*) as n from a{k}, range(1, 17) t(i) group by all),
m{k} as (select part, entry, list(case when s >= 0 then s // n else -((n - 1 - s) // n) end order by i) as c from s{k} group by all),
b{k + 1} as (select part, entry, coalesce(m{k}.c, b{k}.c) as c from b{k} left join m{k} using (part, entry)),
"""
    return f"""
with k as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_id, label, part, v[part * 16 + 1 : part * 16 + 16] as v from k, range(0, 4) t(part)),
b0 as (select part, entry, v as c from (select part, v, row_number() over (partition by part order by vec_id) - 1 as entry from p) where entry < 256),
{rounds}{nearest.format(k=ROUNDS)},
z as (select vec_id, label, string_agg(printf('%02x', best % 256), '' order by part) as code, sum(best // 256)::bigint as error from a{ROUNDS} group by all),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
select vec_id, label, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from z, h"""
