"""Hashed n-grams of many texts at once, on numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from attestry.llm.common import mix

FOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """For every code point its lower case, where that is one code point; else itself."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of rows of UTF-8 bytes, and each row's bounds among them."""
    held = raw.tobytes()
    try:
        points = np.frombuffer(held.decode().encode("utf-32-le"), "<u4")
        return points, np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at]
    except UnicodeDecodeError:  # broken bytes: row by row, so that bounds stay right
        rows = [np.frombuffer(held[a:b].decode(errors="replace").encode("utf-32-le"), "<u4") for a, b in zip(at[:-1], at[1:])]
        return np.concatenate([np.zeros(0, "<u4"), *rows]), np.cumsum([0, *map(len, rows)])


def char_ngrams(points: np.ndarray, at: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash bucket of every n-gram of ``order`` code points; none crosses two rows."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h = h * FOLD + points[k : k + n]
    inside = row[:n] == row[order - 1 :]
    bucket = mix(h[inside] + np.uint64(order)) >> np.uint64(64 - bits)
    return row[:n][inside], bucket.astype(np.int64)
