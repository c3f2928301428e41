"""Pixels in numpy: PNG files, resizing, colour spaces, blurs, rasters.  Images are height x width or height x width x channels."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(body: bytes) -> np.ndarray:
    """uint8 height x width (gray) or height x width x 3; alpha is dropped, palettes are looked up, 16 bits become 8.  Interlaced files are an error."""
    if body[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, palette = 8, [], None
    while at < len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        part = body[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            wide, high, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(part)
    if interlace:
        raise ValueError("interlaced PNG files are not read")
    channels = _CHANNELS[colour]
    row, step = (wide * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(high, row + 1)
    lines = _unfilter(raw[:, 0], raw[:, 1:], step)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(high, -1, depth)
        values = bits @ (1 << np.arange(depth - 1, -1, -1))
        values = values[:, : wide * channels].astype(np.uint8)
        if colour != 3:
            values = (values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    else:
        values = lines[:, ::2] if depth == 16 else lines
    image = values.reshape(high, wide, channels)
    if colour == 3:
        return palette[image[:, :, 0]]
    return np.ascontiguousarray(image[:, :, 0] if channels < 3 else image[:, :, :3])


def _unfilter(kinds: np.ndarray, data: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(data.shape, np.uint8)
    above = np.zeros(data.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = data[y]
        if kind == 0:
            row = line.copy()
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = np.zeros_like(line)
            for c in range(step):
                row[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        else:
            row = _serial(line.tolist(), above.tolist(), step, kind)
        out[y] = above = row
    return out


def _serial(line: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    """Average (3) and Paeth (4) depend on the pixel before."""
    row = [0] * len(line)
    for i, x in enumerate(line):
        left, corner = (row[i - step], above[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + above[i]) // 2
        else:
            by = abs(above[i] - corner), abs(left - corner), abs(left + above[i] - 2 * corner)
            guess = left if by[0] <= by[1] and by[0] <= by[2] else above[i] if by[1] <= by[2] else corner
        row[i] = (x + guess) & 255
    return np.array(row, np.uint8)


def _bicubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


#: name: (reach, weight at a distance), of antialiased resampling
KERNELS = {
    "bilinear": (1.0, lambda x: np.maximum(0.0, 1 - np.abs(x))),
    "bicubic": (2.0, _bicubic),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
}


@lru_cache(64)
def _weights(old: int, new: int, kernel: str) -> np.ndarray:
    reach, weight = KERNELS[kernel]
    scale = old / new
    spread = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    w = weight((np.arange(old)[None, :] + 0.5 - centre[:, None]) / spread)
    w[np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) >= reach * spread] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, high: int, wide: int, kernel: str = "bilinear") -> np.ndarray:
    """uint8 of the new size; other types are clipped to 0..255 first."""
    image = np.clip(image, 0, 255).astype(np.uint8)
    if kernel == "nearest":
        y, x = ((np.arange(n) + 0.5) * old / n for n, old in zip((high, wide), image.shape, strict=False))
        return image[y.astype(int)][:, x.astype(int)]
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}")
    return to_uint8(scaled(image, high, wide, kernel))


def scaled(values: np.ndarray, high: int, wide: int, kernel: str = "bilinear") -> np.ndarray:
    out = np.tensordot(_weights(values.shape[0], high, kernel), values.astype(float), (1, 0))
    out = np.tensordot(_weights(values.shape[1], wide, kernel), out, (1, 1))
    return np.moveaxis(out, 0, 1)


def to_uint8(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """rgb and hsv in 0..1, last axis 3."""
    most, least = rgb.max(-1), rgb.min(-1)
    span = most - least
    safe = np.where(span == 0, 1, span)
    r, g, b = np.moveaxis(rgb, -1, 0)
    hue = np.where(most == r, (g - b) / safe, np.where(most == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) / 6 % 1.0
    return np.stack([np.where(span == 0, 0, hue), np.where(most == 0, 0, span / np.where(most == 0, 1, most)), most], -1)


def to_rgb(hsv: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(hsv, -1, 0)
    k = (np.array([5, 3, 1]) + 6 * h[..., None]) % 6
    return v[..., None] * (1 - s[..., None] * np.clip(np.minimum(k, 4 - k), 0, 1))


def blur(values: np.ndarray, sigma: float, reach: float = 4.0, mode: str = "edge") -> np.ndarray:
    """Gaussian over the first two axes."""
    n = int(reach * sigma + 0.5)
    if n == 0:
        return values.astype(float)
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    out = values.astype(float)
    for axis in (0, 1):
        pad = [(n, n) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode)
        size = out.shape[axis]
        out = sum(w[i] * np.take(wide, range(i, i + size), axis) for i in range(2 * n + 1))
    return out


def filtered(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of the first two axes with a small kernel; edges are mirrored."""
    a, b = kernel.shape
    pad = [(a // 2, a - 1 - a // 2), (b // 2, b - 1 - b // 2)] + [(0, 0)] * (values.ndim - 2)
    wide = np.pad(values.astype(float), pad, "reflect")
    high, across = values.shape[:2]
    return sum(kernel[i, j] * wide[i : i + high, j : j + across] for i in range(a) for j in range(b) if kernel[i, j])


def sampled(values: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at real coordinates; outside, the edge mirrored."""
    high, wide = values.shape[:2]

    def inside(c: np.ndarray, n: int) -> np.ndarray:
        c = np.abs(c) % (2 * max(n - 1, 1))
        return np.where(c > n - 1, 2 * (n - 1) - c, c)

    y, x = inside(y, high), inside(x, wide)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, high - 1), np.minimum(x0 + 1, wide - 1)
    fy, fx = y - y0, x - x0
    if values.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return (values[y0, x0] * (1 - fx) + values[y0, x1] * fx) * (1 - fy) + (values[y1, x0] * (1 - fx) + values[y1, x1] * fx) * fy


def grid(images: list[np.ndarray], columns: int, cell: int = 32) -> np.ndarray:
    """A raster of thumbnails, row by row, on white."""
    rows = max(1, -(-len(images) // columns))
    out = np.full((rows * (cell + 2), columns * (cell + 2), 3), 255, np.uint8)
    for i, image in enumerate(images):
        y, x = (i // columns) * (cell + 2) + 1, (i % columns) * (cell + 2) + 1
        small = resize(image, cell, cell)
        out[y : y + cell, x : x + cell] = small if small.ndim == 3 and small.shape[2] == 3 else small.reshape(cell, cell, 1)
    return out


def bars(counts: list[float], high: int = 64, wide: int = 8) -> np.ndarray:
    """A raster of vertical bars."""
    out = np.full((high, max(1, len(counts)) * wide, 3), 255, np.uint8)
    most = max([*counts, 1])
    for i, n in enumerate(counts):
        out[high - round(high * n / most) :, i * wide + 1 : (i + 1) * wide - 1] = (70, 110, 180)
    return out
