"""Pixels to perceptual hashes, in numpy."""

from __future__ import annotations

import numpy as np

COLS, ROWS = 9, 8
#: Quality of reduced pixels: weights of red, green and blue in luminance.
LUMA = (0.299, 0.587, 0.114)


def orient(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Rows turned upright by EXIF orientation (1 to 8; others stay); works for grey and colour."""
    turned = {
        2: lambda p: p[:, ::-1],
        3: lambda p: p[::-1, ::-1],
        4: lambda p: p[::-1],
        5: lambda p: p.swapaxes(0, 1),
        6: lambda p: p[::-1].swapaxes(0, 1),
        7: lambda p: p[::-1, ::-1].swapaxes(0, 1),
        8: lambda p: p[:, ::-1].swapaxes(0, 1),
    }
    return turned.get(orientation, lambda p: p)(pixels)


def _weights(size: int, out: int) -> np.ndarray:
    """Share of each input pixel in each output pixel: areas that overlap (a smooth triangle when enlarging)."""
    edges = np.linspace(0, size, out + 1)
    if size >= out:
        low, high = np.maximum(edges[:-1, None], np.arange(size)), np.minimum(edges[1:, None], np.arange(size) + 1)
        w = np.maximum(0, high - low)
    else:
        centre = (edges[:-1] + edges[1:]) / 2 - 0.5
        w = np.maximum(0, 1 - np.abs(np.clip(centre, 0, size - 1)[:, None] - np.arange(size)))
    return w / w.sum(axis=1, keepdims=True)


def grid(pixels: np.ndarray) -> np.ndarray:
    """72 grey values (8 rows of 9) of a picture, grey or RGB."""
    p = pixels.astype(np.float64)
    small = np.tensordot(_weights(p.shape[0], ROWS), p, (1, 0))
    small = np.moveaxis(np.tensordot(_weights(p.shape[1], COLS), small, (1, 1)), 0, 1)
    if small.ndim == 3:
        small = np.floor(np.clip(np.rint(small), 0, 255) @ np.array(LUMA, np.float32).astype(np.float64) + 1e-6)
    else:
        small = np.rint(small)
    return np.clip(small, 0, 255).astype(np.int64).reshape(-1)


def _signed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def average_hash(g: np.ndarray) -> int:
    """As functions.hashing.average_hash, of one grid."""
    left = g.reshape(ROWS, COLS)[:, : COLS - 1].reshape(-1)
    return _signed(left >= left.sum() // 64)


def difference_hash(g: np.ndarray) -> int:
    """As functions.hashing.difference_hash, of one grid."""
    m = g.reshape(ROWS, COLS)
    return _signed((m[:, :-1] > m[:, 1:]).reshape(-1))
