"""Image corruptions at severities 1 to 5: corrupt(image, name, severity, rng) -> uint8 of the same shape.

Images are uint8, 32 x 32 or larger, with 1 or 3 channels.  Frost needs textures, which the
caller gives; jpeg_compression quantises cosine coefficients as that format does, without files.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import pixels as px

# Severity constants of the published benchmark.
GAUSSIAN_NOISE = [0.08, 0.12, 0.18, 0.26, 0.38]
SHOT_NOISE = [60, 25, 12, 5, 3]
IMPULSE_NOISE = [0.03, 0.06, 0.09, 0.17, 0.27]
SPECKLE_NOISE = [0.15, 0.2, 0.35, 0.45, 0.6]
GAUSSIAN_BLUR = [1, 2, 3, 4, 6]
DEFOCUS_BLUR = [(3, 0.1), (4, 0.5), (6, 0.5), (8, 0.5), (10, 0.5)]
GLASS_BLUR = [(0.7, 1, 2), (0.9, 2, 1), (1, 2, 3), (1.1, 3, 2), (1.5, 4, 2)]
MOTION_BLUR = [(10, 3), (15, 5), (15, 8), (15, 12), (20, 15)]
ZOOM_BLUR = [(1.11, 0.01), (1.16, 0.01), (1.21, 0.02), (1.26, 0.02), (1.31, 0.03)]
SNOW = [(0.1, 0.3, 3, 0.5, 10, 4, 0.8), (0.2, 0.3, 2, 0.5, 12, 4, 0.7), (0.55, 0.3, 4, 0.9, 12, 8, 0.7), (0.55, 0.3, 4.5, 0.85, 12, 8, 0.65), (0.55, 0.3, 2.5, 0.85, 12, 12, 0.55)]
FROST = [(1, 0.4), (0.8, 0.6), (0.7, 0.7), (0.65, 0.7), (0.6, 0.75)]
FOG = [(1.5, 2), (2, 2), (2.5, 1.7), (2.5, 1.5), (3, 1.4)]
BRIGHTNESS = [0.1, 0.2, 0.3, 0.4, 0.5]
CONTRAST = [0.4, 0.3, 0.2, 0.1, 0.05]
SATURATE = [(0.3, 0), (0.1, 0), (2, 0), (5, 0.1), (20, 0.2)]
ELASTIC_TRANSFORM = [(488, 170.8, 24.4), (488, 19.52, 48.8), (12.2, 2.44, 4.88), (17.08, 2.44, 4.88), (29.28, 2.44, 4.88)]
PIXELATE = [0.6, 0.5, 0.4, 0.3, 0.25]
JPEG_COMPRESSION = [25, 18, 15, 10, 7]
SPATTER = [(0.65, 0.3, 4, 0.69, 0.6, 0), (0.65, 0.3, 3, 0.68, 0.6, 0), (0.65, 0.3, 2, 0.68, 0.5, 0), (0.65, 0.3, 1, 0.65, 1.5, 1), (0.67, 0.4, 1, 0.65, 1.5, 1)]
# Quantisation tables of the JPEG standard.
LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32


def _gray(x: np.ndarray) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114]) if x.shape[2] == 3 else x[:, :, 0]


def gaussian_noise(x, s, rng):  # noqa: ANN001, ANN201
    return x + rng.normal(0, GAUSSIAN_NOISE[s], x.shape)


def shot_noise(x, s, rng):  # noqa: ANN001, ANN201
    return rng.poisson(x * SHOT_NOISE[s]) / SHOT_NOISE[s]


def impulse_noise(x, s, rng):  # noqa: ANN001, ANN201
    hit, salt = rng.random(x.shape) < IMPULSE_NOISE[s], rng.random(x.shape) < 0.5
    return np.where(hit, salt.astype(float), x)


def speckle_noise(x, s, rng):  # noqa: ANN001, ANN201
    return x + x * rng.normal(0, SPECKLE_NOISE[s], x.shape)


def gaussian_blur(x, s, rng):  # noqa: ANN001, ANN201
    return px.blur(x, GAUSSIAN_BLUR[s])


def _disk(radius: int, soft: float) -> np.ndarray:
    n = max(8, radius)
    y, x = np.mgrid[-n : n + 1, -n : n + 1]
    k = px.blur((x * x + y * y <= radius * radius).astype(float), soft, mode="constant")
    return k / k.sum()


def defocus_blur(x, s, rng):  # noqa: ANN001, ANN201
    return px.filtered(x, _disk(*DEFOCUS_BLUR[s]))


def glass_blur(x, s, rng):  # noqa: ANN001, ANN201
    sigma, reach, times = GLASS_BLUR[s]
    out = px.blur(x, sigma)
    high, wide = x.shape[:2]
    for _ in range(times):
        shift = rng.integers(-reach, reach, (high, wide, 2))
        for y in range(high - reach - 1, reach, -1):
            for c in range(wide - reach - 1, reach, -1):
                dy, dx = shift[y, c]
                out[[y, y + dy], [c, c + dx]] = out[[y + dy, y], [c + dx, c]]
    return px.blur(out, sigma)


def _smeared(x: np.ndarray, radius: int, sigma: float, degrees: float) -> np.ndarray:
    """Shifted copies along one direction, weighed by half a bell curve."""
    w = np.exp(-0.5 * (np.arange(2 * radius + 1) / sigma) ** 2)
    y, c = np.mgrid[: x.shape[0], : x.shape[1]].astype(float)
    a = np.deg2rad(degrees)
    return sum(p * px.sampled(x, y - i * np.sin(a), c - i * np.cos(a)) for i, p in enumerate(w / w.sum()))


def motion_blur(x, s, rng):  # noqa: ANN001, ANN201
    return _smeared(x, *MOTION_BLUR[s], rng.uniform(-45, 45))


def _zoomed(x: np.ndarray, factor: float) -> np.ndarray:
    """The middle, enlarged to the whole."""
    high, wide = x.shape[:2]
    y, c = np.mgrid[:high, :wide].astype(float)
    return px.sampled(x, (y - (high - 1) / 2) / factor + (high - 1) / 2, (c - (wide - 1) / 2) / factor + (wide - 1) / 2)


def zoom_blur(x, s, rng):  # noqa: ANN001, ANN201
    factors = np.arange(1, *ZOOM_BLUR[s])
    return (x + sum(_zoomed(x, f) for f in factors)) / (len(factors) + 1)


def _plasma(size: int, decay: float, rng: np.random.Generator) -> np.ndarray:
    """A cloud by diamonds and squares: noise of falling strength on ever finer, wrapped grids; 0 to 1."""
    n = 1 << (max(size, 2) - 1).bit_length()
    field, step, strength = np.zeros((n, n)), n, 100.0
    while step > 1:
        half = step // 2
        corner = field[::step, ::step]
        right, below = np.roll(corner, -1, 1), np.roll(corner, -1, 0)
        noise = lambda like: rng.uniform(-strength, strength, like.shape)
        middle = (corner + right + below + np.roll(right, -1, 0)) / 4 + noise(corner)
        field[half::step, half::step] = middle
        field[::step, half::step] = (corner + right + middle + np.roll(middle, 1, 0)) / 4 + noise(corner)
        field[half::step, ::step] = (corner + below + middle + np.roll(middle, 1, 1)) / 4 + noise(corner)
        step, strength = half, strength / decay
    field -= field.min()
    return field[:size, :size] / max(field.max(), 1e-12)


def fog(x, s, rng):  # noqa: ANN001, ANN201
    amount, decay = FOG[s]
    cloud = _plasma(max(x.shape[:2]), decay, rng)[: x.shape[0], : x.shape[1], None]
    most = x.max()
    return (x + amount * cloud) * most / (most + amount)


def frost(x, s, rng, textures=None):  # noqa: ANN001, ANN201
    if not textures:
        raise ValueError("frost needs textures")
    own, ice = FROST[s]
    texture = textures[int(rng.integers(len(textures)))]
    if texture.shape[0] < x.shape[0] or texture.shape[1] < x.shape[1]:
        texture = px.resize(texture, max(texture.shape[0], x.shape[0]), max(texture.shape[1], x.shape[1]))
    y, c = (int(rng.integers(t - n + 1)) for t, n in zip(texture.shape, x.shape[:2], strict=False))
    part = texture[y : y + x.shape[0], c : c + x.shape[1]].reshape(*x.shape[:2], -1) / 255
    return own * x + ice * (part if part.shape[2] == x.shape[2] else part.mean(2, keepdims=True))


def snow(x, s, rng):  # noqa: ANN001, ANN201
    mean, spread, zoom, floor, radius, sigma, mixed = SNOW[s]
    flakes = _zoomed(rng.normal(mean, spread, x.shape[:2]), zoom)
    flakes = _smeared(np.clip(np.where(flakes < floor, 0, flakes), 0, 1), radius, sigma, rng.uniform(-135, -45))[..., None]
    pale = np.maximum(x, (_gray(x) * 1.5 + 0.5)[..., None])
    return mixed * x + (1 - mixed) * pale + flakes + np.rot90(flakes, 2)


def _lightened(x: np.ndarray, channel: int, change: Callable) -> np.ndarray:
    if x.shape[2] == 1:
        return change(x) if channel == 2 else x
    hsv = px.to_hsv(x)
    hsv[..., channel] = np.clip(change(hsv[..., channel]), 0, 1)
    return px.to_rgb(hsv)


def brightness(x, s, rng):  # noqa: ANN001, ANN201
    return _lightened(x, 2, lambda v: v + BRIGHTNESS[s])


def saturate(x, s, rng):  # noqa: ANN001, ANN201
    by, plus = SATURATE[s]
    return _lightened(x, 1, lambda v: v * by + plus)


def contrast(x, s, rng):  # noqa: ANN001, ANN201
    mean = x.mean((0, 1), keepdims=True)
    return (x - mean) * CONTRAST[s] + mean


def elastic_transform(x, s, rng):  # noqa: ANN001, ANN201
    alpha, sigma, jitter = (v * min(x.shape[:2]) / 244 for v in ELASTIC_TRANSFORM[s])
    high, wide = x.shape[:2]
    y, c = np.mgrid[:high, :wide].astype(float)
    # three corners of a triangle are moved; the plane follows them
    middle, reach = np.array([high, wide]) / 2, min(high, wide) / 3
    corners = np.array([middle + reach, [middle[0] + reach, middle[1] - reach], middle - reach])
    moved = corners + rng.uniform(-jitter, jitter, corners.shape)
    plane = np.linalg.solve(np.c_[moved, np.ones(3)], corners)
    at = np.stack([y, c, np.ones_like(y)], -1) @ plane
    dy, dx = (px.blur(rng.uniform(-1, 1, (high, wide)), sigma, 3, "reflect" if 3 * sigma < min(high, wide) - 1 else "wrap") * alpha for _ in range(2))
    return px.sampled(x, at[..., 0] + dy, at[..., 1] + dx)


def pixelate(x, s, rng):  # noqa: ANN001, ANN201
    high, wide = (max(1, int(n * PIXELATE[s])) for n in x.shape[:2])
    return px.resize(px.resize(px.to_uint8(x * 255), high, wide), *x.shape[:2], "nearest") / 255


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each 8 x 8 block to cosine coefficients, rounded to the table's multiples, and back."""
    high, wide = plane.shape
    full = np.pad(plane, ((0, -high % 8), (0, -wide % 8)), "edge") - 128
    k = np.arange(8)
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    blocks = full.reshape(full.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    found = np.round(basis @ blocks @ basis.T / table) * table
    return ((basis.T @ found @ basis).transpose(0, 2, 1, 3).reshape(full.shape) + 128)[:high, :wide]


def jpeg_compression(x, s, rng):  # noqa: ANN001, ANN201
    quality = JPEG_COMPRESSION[s]
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    luma, chroma = (np.clip((np.array(t.split(), int).reshape(8, 8) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA))
    x = x * 255
    if x.shape[2] == 1:
        return _quantised(x[:, :, 0], luma)[..., None] / 255
    to = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    parts = x @ to.T + [0, 128, 128]
    high, wide = x.shape[:2]
    out = [_quantised(parts[..., 0], luma)]
    for c in (1, 2):  # colour at half the size
        small = px.scaled(parts[..., c], -(-high // 2), -(-wide // 2))
        out.append(px.scaled(_quantised(small, chroma), high, wide))
    return (np.stack(out, -1) - [0, 128, 128]) @ np.linalg.inv(to).T / 255


def spatter(x, s, rng):  # noqa: ANN001, ANN201
    mean, spread, sigma, floor, strength, mud = SPATTER[s]
    drops = px.blur(rng.normal(mean, spread, x.shape[:2]), sigma)
    drops = np.where(drops < floor, 0, drops)
    if mud:
        mask = px.blur((drops > floor).astype(float), strength)[..., None]
        mask = np.where(mask < 0.8, 0, mask)
        colour = np.array([63, 42, 20]) / 255 if x.shape[2] == 3 else np.array([42]) / 255
        return x * (1 - mask) + colour * mask
    # water: bright at one side of a drop's edge
    edge = px.filtered(px.blur((drops > 0).astype(float), 1), np.array([[-2, -1, 0], [-1, 1, 1], [0, 1, 2]]))
    mask = drops * np.clip(edge, 0, 1)
    mask = (mask / max(mask.max(), 1e-12) * strength)[..., None]
    colour = np.array([175, 238, 238]) / 255 if x.shape[2] == 3 else np.array([238]) / 255
    return x + colour * mask


GROUPS = {
    "noise": [gaussian_noise, shot_noise, impulse_noise],
    "blur": [defocus_blur, glass_blur, motion_blur, zoom_blur],
    "weather": [snow, frost, fog, brightness],
    "digital": [contrast, elastic_transform, pixelate, jpeg_compression],
    "validation": [speckle_noise, gaussian_blur, spatter, saturate],
}
CORRUPTIONS = {f.__name__: f for group in GROUPS.values() for f in group}


def names(group: str = "common") -> list[str]:
    """all, common (the first four groups), or one group."""
    if group in ("all", "common"):
        return [f.__name__ for g, fs in GROUPS.items() for f in fs if group == "all" or g != "validation"]
    return [f.__name__ for f in GROUPS[group]]


def corrupt(image: np.ndarray, name: str, severity: int, rng: np.random.Generator, textures: list[np.ndarray] | None = None) -> np.ndarray:
    if name not in CORRUPTIONS or severity not in range(1, 6):
        raise ValueError(f"no corruption {name} of severity {severity}")
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or min(image.shape[:2]) < 32 or (image.ndim == 3 and image.shape[2] not in (1, 3)):
        raise ValueError(f"can't corrupt {image.dtype} {image.shape}")
    x = image.reshape(*image.shape[:2], -1) / 255
    more = {"textures": textures} if name == "frost" else {}
    out = np.clip(CORRUPTIONS[name](x, severity - 1, rng, **more), 0, 1) * 255
    return out.astype(np.uint8).reshape(image.shape)
