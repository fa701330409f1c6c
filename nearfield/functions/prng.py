"""The seeded generator that rotations, centroid picks and graph levels draw from. Driver and task side only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_M = 0xFFFFFFFF


def mulberry32(seed: int) -> Callable[[], float]:
    """Uniform numbers in [0, 1) from a 32-bit state (the public-domain mulberry32)."""
    state = seed & _M

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _M
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & _M
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & _M)) & _M
        return (t ^ (t >> 14)) / 4294967296

    return draw


def random_signs(n: int, seed: int) -> np.ndarray:
    draw = mulberry32(seed)
    return np.array([-1.0 if draw() < 0.5 else 1.0 for _ in range(n)])
