"""Sound in numpy: WAV files, resampling, log-mel spectrograms."""

from __future__ import annotations

import struct
from functools import lru_cache
from math import gcd

import numpy as np


def decode_wav(body: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 in -1..1 and the sample rate; PCM of 8 to 32 bits or 32- and 64-bit floats, channels averaged."""
    if body[:4] != b"RIFF" or body[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head, data = 12, None, b""
    while at + 8 <= len(body):
        kind, size = struct.unpack("<4sI", body[at : at + 8])
        part = body[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            head = struct.unpack("<HHIIHH", part[:16])
            if head[0] == 0xFFFE:
                head = (struct.unpack("<H", part[24:26])[0], *head[1:])
        elif kind == b"data":
            data = part
        at += 8 + size + size % 2
    form, channels, rate, _, _, bits = head
    data = data[: len(data) // (channels * bits // 8) * (channels * bits // 8)]
    if form == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(float)
    elif form != 1:
        raise ValueError(f"unknown WAV format {form}")
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate


def resample(x: np.ndarray, old: int, new: int, reach: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation, low-passed at the lower of both rates."""
    if old == new or not len(x):
        return x.astype(np.float32)
    common = gcd(old, new)
    old, new = old // common, new // common
    cut = min(1.0, new / old)
    half = int(np.ceil(reach / cut))
    full = np.pad(x.astype(float), half)
    n = -(-len(x) * new // old)
    out = np.zeros(n)
    for phase in range(min(new, n)):  # every new-th sample has the same fraction
        at = np.arange(phase, n, new)
        base, rest = divmod(phase * old, new)
        d = np.arange(-half + 1, half + 1) - rest / new
        w = cut * np.sinc(cut * d) * np.cos(np.pi * np.clip(d / half, -1, 1) / 2) ** 2
        first = base + (at - phase) // new * old + 1
        out[at] = full[first[:, None] + np.arange(2 * half)[None, :]] @ w if len(at) * half < 1 << 24 else [full[f : f + 2 * half] @ w for f in first]
    return out.astype(np.float32)


def _mel(hz: np.ndarray) -> np.ndarray:
    """Linear below 1000 Hz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, 3 * hz / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, 200 * mel / 3, 1000 * np.exp(np.log(6.4) / 27 * (mel - 15)))


@lru_cache(16)
def mel_filters(rate: int, n_fft: int, n_mels: int, low: float, high: float) -> np.ndarray:
    """n_mels triangles over the n_fft / 2 + 1 frequencies, each of unit area."""
    edges = _hz(np.linspace(*_mel(np.array([low, high])), n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int, n_fft: int, hop: int, n_mels: int, low: float = 0.0, high: float | None = None, power: float = 2.0, floor: float = 80.0) -> np.ndarray:
    """float32 n_mels x frames in dB, at most ``floor`` dB under the largest; frames are centred and the ends padded with zeros."""
    full = np.pad(x.astype(float), n_fft // 2)
    n = max(0, (len(full) - n_fft) // hop + 1)
    frames = full[np.arange(n)[:, None] * hop + np.arange(n_fft)[None, :]]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    spectrum = np.abs(np.fft.rfft(frames * window, axis=1)) ** power
    mel = mel_filters(rate, n_fft, n_mels, low, high or rate / 2) @ spectrum.T
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    return np.maximum(db, db.max() - floor).astype(np.float32) if db.size else db.astype(np.float32)
