"""Signals as arrays: resampling by rational rates, and log-mel spectrograms, in Arrow batches."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

#: Zero crossings of the filter on each side.
CROSSINGS = 16
#: Output samples whose products are held at once.
_BLOCK = 1 << 16


def taps(up: int, down: int, crossings: int = CROSSINGS) -> np.ndarray:
    """A sinc of the lower of both rates under a raised cosine, at ``up`` times the input's rate."""
    wide = max(up, down)
    t = np.arange(-crossings * wide, crossings * wide + 1)
    return up / wide * np.sinc(t / wide) * (0.5 + 0.5 * np.cos(np.pi * t / (crossings * wide)))


def resample(signal: np.ndarray, up: int, down: int, crossings: int = CROSSINGS) -> np.ndarray:
    """``signal`` at up/down of its rate, as ceil(n * up / down) samples; it is 0 before and after.

    Only the phase of the filter that meets input samples is used for an output sample.
    """
    g = gcd(up, down)
    up, down = up // g, down // g
    n = -(-len(signal) * up // down)
    if up == down or not n:
        return np.asarray(signal, np.float64)[:n]
    h = taps(up, down, crossings)
    half = (len(h) - 1) // 2
    each = 2 * half // up + 2  # input samples below the filter, at most
    padded = np.concatenate([np.zeros(each), signal, np.zeros(each)])
    phases = np.zeros((up, each))
    for p in range(up):  # an output sample at p beyond a whole input sample
        first = -((half - p) // up)  # the first input sample below the filter, from there
        k = np.arange(first, first + each)
        at = p - k * up + half
        met = (at >= 0) & (at < len(h))
        phases[p, met] = h[at[met]]
    firsts = np.array([-((half - p) // up) for p in range(up)])
    out = np.empty(n)
    for begin in range(0, n, _BLOCK):
        m = np.arange(begin, min(n, begin + _BLOCK)) * down
        phase = m % up
        start = m // up + firsts[phase] + each
        out[begin : begin + len(m)] = np.einsum("ij,ij->i", phases[phase], padded[start[:, None] + np.arange(each)])
    return out


def resampled(samples: Column, rate: Column | int, target: int = 16_000, crossings: int = CROSSINGS) -> Column:
    """Samples at the target rate; null stays null."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def made(signals: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or r is None or r != r else resample(np.asarray(s, np.float64), target, int(r), crossings) for s, r in zip(signals, rates, strict=True)])

    return made(samples, F.lit(rate) if isinstance(rate, int) else rate)


def hertz_to_mel(f: np.ndarray) -> np.ndarray:
    """Even steps up to 1,000 Hz, even ratios beyond: 15 mels each."""
    f = np.asarray(f, np.float64)
    return np.where(f < 1000, 3 * f / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_to_hertz(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, np.float64)
    return np.where(m < 15, 200 * m / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_filters(rate: int, size: int, mels: int) -> np.ndarray:
    """(mels, bins): triangles between neighbouring mels, each of area 1."""
    bins = np.linspace(0, rate / 2, size // 2 + 1)
    edge = mel_to_hertz(np.linspace(0, hertz_to_mel(rate / 2), mels + 2))
    rise = (bins - edge[:-2, None]) / np.diff(edge)[:-1, None]
    fall = (edge[2:, None] - bins) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def log_mel(signal: np.ndarray, filters: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(mels, frames) of a signal: one frame a hop, the ends reflected; logarithms no more than 8 below the greatest, a quarter of them plus 1."""
    padded = np.pad(signal, size // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][: len(signal) // hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    out = np.log10(np.maximum(filters @ power.T, 1e-10))
    return (np.maximum(out, out.max() - 8) + 4) / 4 if out.size else out


def spectrogram(samples: Column, rate: int = 16_000, size: int = 400, hop: int = 160, mels: int = 80, length: int | None = 480_000) -> Column:
    """``mels``, ``frames`` and ``values`` (mel by mel) of the log-mel spectrogram of samples that are cut or filled with
    zeros to ``length`` (30 seconds unless it is given; None: as long as they are, if longer than half a window)."""
    kind = StructType([StructField("mels", IntegerType()), StructField("frames", IntegerType()), StructField("values", ArrayType(DoubleType()))])

    @F.pandas_udf(kind)
    def made(signals: pd.Series) -> pd.DataFrame:
        filters = mel_filters(rate, size, mels)
        rows = []
        for s in signals:
            if s is None or (length is None and len(s) <= size // 2):
                rows.append((None, None, None))
                continue
            signal = np.asarray(s, np.float64)[:length]
            values = log_mel(np.pad(signal, (0, (length or len(signal)) - len(signal))), filters, size, hop)
            rows.append((mels, values.shape[1], values.ravel()))
        return pd.DataFrame(rows, columns=["mels", "frames", "values"])

    return made(samples)
