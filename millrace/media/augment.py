"""Random changes of one image: (uint8 image, rng, params) -> uint8 image of the same type."""

from __future__ import annotations

import numpy as np

from . import pixels as px

_PAD = {"reflect": "reflect", "edge": "edge", "zero": "constant"}


def random_crop(image: np.ndarray, rng: np.random.Generator, size: int, padding: int = 0, padding_mode: str = "zero") -> np.ndarray:
    """A size x size part of the padded image at a random place."""
    pad = [(padding, padding)] * 2 + [(0, 0)] * (image.ndim - 2)
    full = np.pad(image, pad, _PAD[padding_mode]) if padding else image
    if min(full.shape[:2]) < size:
        raise ValueError(f"can't crop {size} from {full.shape}")
    y, x = (int(rng.integers(n - size + 1)) for n in full.shape[:2])
    return full[y : y + size, x : x + size].copy()


def horizontal_flip(image: np.ndarray, rng: np.random.Generator, p: float = 0.5) -> np.ndarray:
    return image[:, ::-1].copy() if rng.random() < p else image


def _blend(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    return np.clip(a + (b - a) * share, 0, 255)


def color_jitter(image: np.ndarray, rng: np.random.Generator, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, hue: float = 0.0) -> np.ndarray:
    """Each magnitude m draws a factor from 1 - m to 1 + m (hue: a turn from -m to m), in this order; 0 draws nothing.  Gray images have no saturation and hue."""
    out, colour = image.astype(float), image.ndim == 3 and image.shape[2] == 3
    weights = np.array([0.299, 0.587, 0.114])
    draw = lambda m: rng.uniform(max(0.0, 1 - m), 1 + m)
    if brightness:
        out = _blend(np.zeros_like(out), out, draw(brightness))
    if contrast:
        out = _blend(np.full_like(out, np.floor((out @ weights if colour else out).mean() + 0.5)), out, draw(contrast))
    if saturation:
        share = draw(saturation)
        out = _blend(np.repeat((out @ weights)[..., None], 3, -1), out, share) if colour else out
    if hue and colour:
        hsv = px.to_hsv(out / 255)
        hsv[..., 0] = (hsv[..., 0] + rng.uniform(-hue, hue)) % 1.0
        out = px.to_rgb(hsv) * 255
    return px.to_uint8(out)


def random_erasing(image: np.ndarray, rng: np.random.Generator, p: float = 0.5, area: tuple[float, float] = (0.02, 0.33), aspect: tuple[float, float] = (0.3, 3.3)) -> np.ndarray:
    """A rectangle in the mean colour; up to ten tries for one that fits."""
    if rng.random() >= p:
        return image
    high, wide = image.shape[:2]
    for _ in range(10):
        size = rng.uniform(*area) * high * wide
        ratio = np.exp(rng.uniform(*np.log(aspect)))
        h, w = int(round(np.sqrt(size * ratio))), int(round(np.sqrt(size / ratio)))
        if 0 < h < high and 0 < w < wide:
            y, x = int(rng.integers(high - h + 1)), int(rng.integers(wide - w + 1))
            out = image.copy()
            out[y : y + h, x : x + w] = px.to_uint8(image.mean((0, 1)))
            return out
    return image


AUGMENTATIONS = {f.__name__: f for f in (random_crop, horizontal_flip, color_jitter, random_erasing)}
