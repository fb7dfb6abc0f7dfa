"""Pixel functions on RGBA arrays (rows x columns x 4, unsigned bytes)."""

from __future__ import annotations

import numpy as np

# Levels per channel of the reduced palettes, and the default threshold.
LEVELS = {"256": (8, 8, 8), "64": (4, 4, 4), "16": (4, 2, 2), "4": (2, 2, 2)}
THRESHOLD = 180


def luminance(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(float)
    return np.floor(0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2] + 0.5).astype(np.uint8)


def quantise(channel: np.ndarray, levels: int) -> np.ndarray:
    """Nearest of so many equally spaced values."""
    step = np.floor(channel.astype(float) / 255 * (levels - 1) + 0.5)
    return np.floor(step / (levels - 1) * 255 + 0.5).astype(np.uint8)


def reduce_colours(rgba: np.ndarray, mode: str = "none", threshold: int | None = None) -> np.ndarray:
    """``none``, ``grayscale``, ``256``, ``64``, ``16``, ``4`` or ``binary``; all but ``none`` make pixels opaque."""
    if mode == "none":
        return rgba
    out = rgba.copy()
    out[..., 3] = 255
    if mode in LEVELS:
        for k, n in enumerate(LEVELS[mode]):
            out[..., k] = quantise(rgba[..., k], n)
        return out
    gray = luminance(rgba)
    if mode == "binary":
        limit = min(max(THRESHOLD if threshold is None else threshold, 0), 255)
        gray = np.where(gray >= limit, 255, 0).astype(np.uint8)
    elif mode != "grayscale":
        raise ValueError(mode)
    out[..., :3] = gray[..., None]
    return out


def has_alpha(rgba: np.ndarray) -> bool:
    return bool((rgba[..., 3] < 255).any())


def flatten_on_white(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3:].astype(float) / 255
    out = rgba.copy()
    out[..., :3] = np.floor(rgba[..., :3] * a + 255 * (1 - a) + 0.5).astype(np.uint8)
    out[..., 3] = 255
    return out


def is_gray(rgba: np.ndarray) -> bool:
    return bool(((rgba[..., 0] == rgba[..., 1]) & (rgba[..., 1] == rgba[..., 2])).all())


def is_binary(rgba: np.ndarray) -> bool:
    return is_gray(rgba) and bool(np.isin(rgba[..., 0], (0, 255)).all())


def pack_bits(gray: np.ndarray) -> bytes:
    """One bit per pixel, most significant first, rows padded to bytes; bright pixels are 1."""
    return np.packbits(gray >= 128, axis=1).tobytes()


def target_size(width: int, height: int, scale: float = 1.0, max_width: int | None = None) -> tuple[int, int]:
    """Size after resizing: a maximum width goes before a scale, nothing grows, no side below 1."""
    factor = max_width / width if max_width and width > max_width else (scale if not max_width and 0 < scale < 1 else 1.0)
    return max(1, int(width * factor + 0.5)), max(1, int(height * factor + 0.5))


def resize(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area average over whole source rows and columns."""
    def edges(n: int, m: int) -> np.ndarray:
        return np.minimum((np.arange(m) * n) // m, n - 1)

    rows, cols = edges(rgba.shape[0], height), edges(rgba.shape[1], width)
    x = np.add.reduceat(np.add.reduceat(rgba.astype(float), rows, 0), cols, 1)
    size = np.diff(np.append(rows, rgba.shape[0]))[:, None] * np.diff(np.append(cols, rgba.shape[1]))[None, :]
    return np.floor(x / np.maximum(size, 1)[..., None] + 0.5).astype(np.uint8)


def preview(rgba: np.ndarray, side: int = 400, most: int = 24_000_000) -> np.ndarray:
    """Fits the longer side to ``side``; above ``most`` pixels a gray placeholder with a border of 2."""
    height, width = rgba.shape[:2]
    if width * height > most:
        w, h = (300, max(1, 300 * height // width)) if width >= height else (max(1, 300 * width // height), 300)
        out = np.full((h, w, 4), (230, 230, 230, 255), np.uint8)
        out[:2] = out[-2:] = out[:, :2] = out[:, -2:] = (160, 160, 160, 255)
        return out
    if max(width, height) <= side:
        return rgba
    factor = side / max(width, height)
    return resize(rgba, max(1, round(width * factor)), max(1, round(height * factor)))
