"""Audio files of linear PCM or float samples (RIFF/WAVE): read by Spark from any store, decoded in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Names of sample formats: (tag of the format, bits of a sample).
KINDS = {"pcm8": (1, 8), "pcm16": (1, 16), "pcm24": (1, 24), "pcm32": (1, 32), "float32": (3, 32), "float64": (3, 64)}
_EXTENSIBLE = 0xFFFE


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, frames by channels, from -1 to 1) of a file's bytes; ValueError if they aren't such a file.

    Chunks that aren't understood are passed over, samples after the last whole frame are left out, and a
    data chunk that says it is longer than the file ends with it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("the format is cut off")
            tag, channels, rate, _, frame, bits = struct.unpack_from("<HHIIHH", body)
            if tag == _EXTENSIBLE and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            form = tag, channels, rate, frame, bits
        elif name == b"data":
            if form is None:
                raise ValueError("samples come before their format")
            return form[2], _frames(body, *form)
        at += 8 + size + size % 2
    raise ValueError("there are no samples")


def _frames(body: bytes, tag: int, channels: int, rate: int, frame: int, bits: int) -> np.ndarray:
    if (tag, bits) not in KINDS.values() or not channels or not rate or frame != channels * bits // 8:
        raise ValueError(f"samples of {bits} bits, format {tag}, aren't understood")
    body = body[: len(body) // frame * frame]
    if tag == 3:
        flat = np.frombuffer(body, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        flat = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        flat = (wide.view("<i4").ravel() >> 8) / float(1 << 23)
    else:
        flat = np.frombuffer(body, f"<i{bits // 8}") / float(1 << bits - 1)
    return flat.reshape(-1, channels)


def wav_bytes(frames: np.ndarray, rate: int, kind: str = "pcm16") -> bytes:
    """A file of frames by channels, from -1 to 1; integers are rounded half up and what is beyond is cut."""
    tag, bits = KINDS[kind]
    frames = np.asarray(frames, np.float64)
    frames = frames if frames.ndim == 2 else frames.reshape(-1, 1)
    if tag == 3:
        body = frames.astype(f"<f{bits // 8}").tobytes()
    else:
        top = (1 << bits - 1) - 1
        whole = np.clip(np.floor(frames * top + 0.5), -top - 1, top).astype(np.int64)
        body = (whole + 128).astype(np.uint8).tobytes() if bits == 8 else np.ascontiguousarray(whole.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : bits // 8]).tobytes()
    channels = frames.shape[1]
    size = channels * bits // 8
    head = struct.pack("<HHIIHH", tag, channels, rate, rate * size, size, bits)
    rest = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(rest) + 4) + b"WAVE" + rest


def _wavs(frames: pa.Array, kinds: pa.Array, rate: int) -> Iterator[bytes | None]:
    """One file at a time, from the batch's own buffers: frames that are lists of their own would take many times their bytes."""
    for k, kind in enumerate(kinds.to_pylist()):
        clip = frames[k].values
        if clip is None:
            yield None
            continue
        channels = len(clip[0]) if len(clip) else 1
        if not all(n == channels for n in clip.value_lengths().unique().to_pylist()):
            raise ValueError("frames of a file differ in their channels")
        yield wav_bytes(clip.flatten().to_numpy(zero_copy_only=False).reshape(len(clip), channels), rate, kind)


def as_wav(frames: Column, kind: Column, rate: int = 16_000) -> Column:
    """Bytes of a file from an array of frames, each an array by channel, and the name of its sample format."""

    @F.arrow_udf(BinaryType())
    def made(samples: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array(_wavs(samples, kinds, rate), pa.binary())

    return made(frames, kind)


def write_files(rows: DataFrame, path: str, name: str, content: str = "content") -> None:
    """One file a row below ``path/name=<value>/``, by Spark's own writer, so to any store. A line end follows
    the content, which readers of RIFF pass over."""
    rows.select(name, F.col(content).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy(name).text(path)


_AUDIO = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first channel of each file; one file a batch goes out, so memory follows the longest."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rate = channels = samples = error = None
            try:
                rate, frames = parse_wav(content.as_buffer().to_pybytes())
                channels, samples = frames.shape[1], np.ascontiguousarray(frames[:, 0])
            except ValueError as e:
                error = str(e)
            yield pa.record_batch([pa.array([x], t) for x, t in zip((path, rate, channels, samples, error), _AUDIO.types, strict=True)], schema=_AUDIO)


def read_audio(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, rate, channels, samples, error) of every file below a folder; ``path`` is relative to it.

    ``samples`` are those of the first channel. Of a file that isn't understood all is null but ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(whole)), F.substring("path", len(whole) + 1, 1 << 20)).otherwise(F.col("path"))
    return files.select(relative.alias("path"), "content").mapInArrow(_decoded, "path string, rate int, channels int, samples array<double>, error string")
