"""Transforms over rows of frames, with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np


def fft(x: np.ndarray) -> np.ndarray:
    return np.fft.fft(np.asarray(x, np.result_type(x, np.float64)), axis=-1)


@cache
def sine_window(n: int) -> np.ndarray:
    return np.sin(np.pi / n * (np.arange(n) + 0.5))


@cache
def _basis(n: int, scale: float) -> np.ndarray:
    i, k = np.arange(n)[:, None], np.arange(n // 2)[None, :]
    return np.cos(scale * np.pi / n * (i + 0.5 + n / 4) * (k + 0.5))


def _by_fft(x: np.ndarray, scale: int) -> np.ndarray:
    """sum x[i] cos(scale pi / n (i + i0)(k + 1/2)), i0 = 1/2 + n/4, from one transform of 2 n / scale points."""
    n = x.shape[-1]
    size = 2 * n // scale
    i0 = 0.5 + n / 4
    turned = x * np.exp(-0.5j * scale * np.pi / n * np.arange(n))
    if size < n:
        turned = turned.reshape(*x.shape[:-1], n // size, size).sum(axis=-2)
    bins = np.fft.fft(turned, size, axis=-1)[..., : n // 2]
    return (bins * np.exp(-1j * scale * np.pi / n * i0 * (np.arange(n // 2) + 0.5))).real


def mdct_ref(x: np.ndarray) -> np.ndarray:
    """n values to n/2 bins with pi/n, n being the length of the input."""
    x = np.asarray(x, float)
    return x @ _basis(x.shape[-1], 1.0) if x.shape[-1] <= 64 else _by_fft(x, 1)


def mdct(x: np.ndarray) -> np.ndarray:
    """The lapped transform's usual 2 pi/n."""
    x = np.asarray(x, float)
    return x @ _basis(x.shape[-1], 2.0) if x.shape[-1] <= 64 else _by_fft(x, 2)
