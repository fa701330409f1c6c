"""Randomised Hadamard rotation and scalar codes of 8, 4 and 1 bits, in NumPy for Arrow kernels."""

from __future__ import annotations

import numpy as np

from nearfield.functions.prng import random_signs

DEFAULT_SEED = 0x1234567
LEVELS = {8: 127, 4: 7}
#: How many times k candidates are scored exactly.
RERANK_FACTOR = {8: 4, 4: 16, 1: 32}
_PER_BYTE_MULTIPLE = {8: 4, 4: 8, 1: 32}


def padded_dimension(n: int) -> int:
    """The least power of two that is at least n and 4."""
    return 1 << max(2, (n - 1).bit_length())


def check_width(bits: int, padded: int) -> None:
    if bits not in _PER_BYTE_MULTIPLE:
        raise ValueError(f"{bits} bits a coordinate are not supported; one of 8, 4, 1")
    if padded % _PER_BYTE_MULTIPLE[bits]:
        raise ValueError(f"padded dimension {padded} is no multiple of {_PER_BYTE_MULTIPLE[bits]}, as {bits} bits need")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, not scaled."""
    n = x.shape[-1]
    if n & (n - 1):
        raise ValueError(f"length {n} is no power of two")
    x = np.array(x, dtype=np.float64)
    step = 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x


class Rotator:
    """Orthonormal rotation: in each round signs, then the transform; one P x P matrix at the end."""

    def __init__(self, dimension: int, seed: int = DEFAULT_SEED, rounds: int = 2):
        self.dimension, self.padded, self.seed, self.rounds = dimension, padded_dimension(dimension), seed, rounds
        m = np.eye(self.padded)
        self.signs = [random_signs(self.padded, (seed ^ (0x9E3779B9 * (r + 1))) & 0xFFFFFFFF) for r in range(rounds)]
        for s in self.signs:
            m = hadamard(m * (s / np.sqrt(self.padded)))
        self.matrix = m[:dimension]

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, np.float64) @ self.matrix


def quantize(rotated: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes as int8, scales) of rows. 8 and 4 bits: steps of the largest magnitude over 127 or 7, halves up; 1 bit: signs
    as 1 and 0 with the mean magnitude as scale. A zero row has the scale 1 (0 for 1 bit)."""
    check_width(bits, rotated.shape[1])
    if bits == 1:
        return (rotated >= 0).astype(np.int8), np.abs(rotated).mean(axis=1)
    top = np.abs(rotated).max(axis=1, initial=0)
    scale = np.where(top > 0, top, 1.0)
    level = LEVELS[bits]
    return np.clip(np.floor(rotated / scale[:, None] * level + 0.5), -level, level).astype(np.int8), scale


def dequantize(codes: np.ndarray, scale: np.ndarray, bits: int) -> np.ndarray:
    if bits == 1:
        return (codes.astype(np.float64) * 2 - 1) * scale[:, None]
    return codes.astype(np.float64) * (scale / LEVELS[bits])[:, None]


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes as bytes, so that a row takes bits/8 bytes a coordinate."""
    if bits == 8:
        return codes.view(np.uint8)
    if bits == 1:
        return np.packbits(codes.astype(np.uint8), axis=1, bitorder="little")
    low = (codes & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def unpack(packed: np.ndarray, bits: int) -> np.ndarray:
    if bits == 8:
        return packed.view(np.int8)
    if bits == 1:
        return np.unpackbits(packed, axis=1, bitorder="little").astype(np.int8)
    both = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1).astype(np.int8)
    return np.where(both > 7, both - 16, both).astype(np.int8)
