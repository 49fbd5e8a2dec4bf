"""Framing, windows and features of waveforms, as array columns; spectra by numpy in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import uniform


def num_frames(samples: Column, size: int, shift: int, snip: bool = True) -> Column:
    """How many frames a waveform has (G1)."""
    if snip:
        return F.when(samples < size, 0).otherwise(1 + F.floor((samples - size) / shift)).cast("int")
    return F.floor((samples + shift // 2) / shift).cast("int")


def first_sample(frame: Column, size: int, shift: int, snip: bool = True) -> Column:
    """Index of a frame's first sample; negative before the start without snipping (G1)."""
    return frame * shift if snip else frame * shift + shift // 2 - size // 2


def frames(wave: Column, size: int, shift: int) -> Column:
    """All whole frames of an array."""
    n = num_frames(F.size(wave), size, shift)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(wave, i * shift + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def reflected(wave: Column, before: int, after: int) -> Column:
    """The array with its mirror image at both ends."""
    n = F.size(wave)
    return F.concat(F.reverse(F.slice(wave, 1, before)), wave, F.reverse(F.slice(wave, F.greatest(n - after + 1, F.lit(1)), after)))


def window(kind: str, n: int) -> list[float]:
    """Weights of a window function."""
    a = 2 * math.pi / (n - 1)
    f = {
        "hanning": lambda i: 0.5 - 0.5 * math.cos(a * i),
        "sine": lambda i: math.sin(0.5 * a * i),
        "hamming": lambda i: 0.54 - 0.46 * math.cos(a * i),
        "povey": lambda i: (0.5 - 0.5 * math.cos(a * i)) ** 0.85,
        "rectangular": lambda i: 1.0,
        "blackman": lambda i: 0.42 - 0.5 * math.cos(a * i) + 0.08 * math.cos(2 * a * i),
    }[kind]
    return [f(i) for i in range(n)]


def windowed(frame: Column, kind: str, n: int) -> Column:
    return F.zip_with(frame, F.array(*[F.lit(w) for w in window(kind, n)]), lambda x, w: x * w)


def preemphasis(frame: Column, k: float = 0.97) -> Column:
    """x[i] - k x[i - 1], the first sample standing for the one before it."""
    before = F.concat(F.slice(frame, 1, 1), F.slice(frame, 1, F.size(frame) - 1))
    return F.zip_with(frame, before, lambda x, y: x - y * k)


def dithered(frame: Column, key: Column, amount: float, seed: int) -> Column:
    """Hashed noise in [-amount, amount) on each sample."""
    return F.transform(frame, lambda x, i: x + (uniform(F.concat_ws("/", key.cast("string"), i.cast("string")), seed) * 2 - 1) * amount)


def mel(hz: float) -> float:
    return 1127.0 * math.log(1 + hz / 700)


def mel_banks(bins: int, fft: int, rate: float, low: float = 20.0, high: float = 0.0) -> np.ndarray:
    """Triangles on the mel scale, bins x (fft / 2 + 1)."""
    high = high if high > 0 else rate / 2 + high
    edges = np.linspace(mel(low), mel(high), bins + 2)
    at = np.array([mel(rate * k / fft) for k in range(fft // 2 + 1)])
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def fbank(frame: Column, rate: float = 16_000.0, bins: int = 23, ceps: int = 0, lifter: float = 22.0) -> Column:
    """Log mel energies of one frame, or its MFCC where `ceps` is given."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for x in rows:
            x = np.asarray(x, float)
            fft = 1 << max(1, (len(x) - 1).bit_length())
            power = np.abs(np.fft.rfft(x, fft)) ** 2
            e = np.log(np.maximum(mel_banks(bins, fft, rate) @ power, np.finfo(np.float32).eps))
            if ceps:
                k, n = np.arange(ceps)[:, None], np.arange(bins)
                dct = np.sqrt(2 / bins) * np.cos(np.pi * k * (n + 0.5) / bins)
                dct[0] = np.sqrt(1 / bins)
                e = (dct @ e) * (1 + 0.5 * lifter * np.sin(np.pi * np.arange(ceps) / lifter))
            out.append(e.tolist())
        return pd.Series(out)

    return run(frame)


def log_energy(frame: Column) -> Column:
    return F.ln(F.greatest(F.aggregate(frame, F.lit(0.0), lambda a, x: a + x * x), F.lit(1e-10)))


def spectrum(frame: Column) -> Column:
    """Log power spectrum of one frame."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([np.log(np.maximum(np.abs(np.fft.rfft(np.asarray(x, float), 1 << max(1, (len(x) - 1).bit_length()))) ** 2, 1e-10)).tolist() for x in rows])

    return run(frame)


def mixed(clean: Column, noise: Column, snr: Column | float) -> Column:
    """Noise added at a signal-to-noise ratio in dB; a short noise is repeated."""
    n = F.size(clean)
    tiled = F.slice(F.flatten(F.array_repeat(noise, F.ceil(n / F.size(noise)).cast("int"))), 1, n)
    power = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v))
    share = 1 / (F.pow(F.lit(10.0), (F.lit(snr) if not isinstance(snr, Column) else snr) / 20) + 1)
    level = share * power(clean) / F.greatest(power(tiled), F.lit(1e-14))
    return F.zip_with(F.transform(clean, lambda x: x * (1 - share)), tiled, lambda x, y: x + y * level)


def amplitude(wave: Column, kind: str = "avg") -> Column:
    """Mean or peak magnitude."""
    size = F.transform(wave, F.abs)
    return F.array_max(size) if kind == "peak" else F.aggregate(size, F.lit(0.0), lambda a, x: a + x) / F.size(wave)


def rescaled(wave: Column, target: float, kind: str = "avg") -> Column:
    """A waveform scaled to a magnitude."""
    level = F.greatest(amplitude(wave, kind), F.lit(1e-14))
    return F.transform(wave, lambda x: x / level * target)


def convolved(wave: Column, kernel: list[float]) -> Column:
    """The first len(wave) values of a convolution (G9, reverberation)."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([np.convolve(x, kernel)[: len(x)].tolist() for x in rows])

    return run(wave)


def clipped(wave: Column, limit: float) -> Column:
    return F.transform(wave, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def masked(values: Column, key: Column, width: int, seed: int) -> Column:
    """A hashed run of up to `width` values set to zero and the others scaled up in return."""
    n = F.size(values)
    size = F.floor(uniform(key, seed) * (width + 1)).cast("int")
    start = F.floor(uniform(key, seed + 1) * (n - size + 1)).cast("int")
    return F.transform(values, lambda x, i: F.when((i >= start) & (i < start + size), 0.0).otherwise(x * n / F.greatest(n - size, F.lit(1))))


def wav_samples(content: Column) -> Column:
    """Samples of a PCM WAV file with 8, 16 or 32 bits, its first channel."""

    @F.pandas_udf("array<double>")
    def run(files: pd.Series) -> pd.Series:
        out = []
        for data in files:
            at, channels, bits, samples = 12, 1, 16, np.zeros(0)
            while at + 8 <= len(data):
                name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
                body = data[at + 8 : at + 8 + size]
                if name == b"fmt ":
                    channels, bits = int.from_bytes(body[2:4], "little"), int.from_bytes(body[14:16], "little")
                elif name == b"data":
                    raw = np.frombuffer(body, {8: np.uint8, 16: "<i2", 32: "<i4"}[bits])
                    samples = raw[::channels].astype(float) - (128 if bits == 8 else 0)
                at += 8 + size + size % 2
            out.append(samples.tolist())
        return pd.Series(out)

    return run(content)
