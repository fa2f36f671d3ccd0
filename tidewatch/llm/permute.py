"""Keyed permutations of 0..n-1 that need no table: a Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

from .common import mix64

ROUNDS = 6
_STEP = np.array([(r + 1) * 0x9E3779B97F4A7C15 % 2**64 for r in range(ROUNDS)], dtype=np.uint64)


def feistel(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """The image of each x (0 <= x < n) under the permutation of its key. n and key may differ by element.

    The network permutes 0..4^b-1 for the least b with 4^b >= n; a value outside 0..n-1 walks on until it falls inside, in
    four steps or fewer on average.
    """
    x = np.asarray(x, dtype=np.uint64)
    n = np.broadcast_to(np.asarray(n, dtype=np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, dtype=np.uint64), x.shape)
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64)
    bits = np.where((np.uint64(1) << (np.uint64(2) * bits)) < n, bits + np.uint64(1), bits)
    out = x.copy()
    at = np.arange(len(x))
    while len(at):
        b, k, v = bits[at], key[at], out[at]
        mask = (np.uint64(1) << b) - np.uint64(1)
        left, right = v >> b, v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix64(right + mix64(k + _STEP[r])) & mask)
        v = (left << b) | right
        out[at] = v
        at = at[v >= n[at]]
    return out.astype(np.int64)
