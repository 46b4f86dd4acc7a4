"""Places of points along a Hilbert curve, for whole arrays of points at once."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point on the curve through a grid of 2**bits cells a side.

    ``cells`` is (points, dimensions) of whole numbers; bits times dimensions is 63 at most. From the highest bit down,
    the part of the grid that a point lies in is turned so that the curve enters it at its origin: where the bit of a
    dimension is set the lower bits of the first are inverted, elsewhere both change places. What is then read
    across the dimensions, bit by bit, is the Gray code of the place.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        below = np.uint64((1 << bit) - 1)
        for d in range(dims):
            is_set = (x[d] >> np.uint64(bit) & np.uint64(1)).astype(bool)
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(is_set, below, swap)
            x[d] ^= swap
    gray = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            gray = gray << np.uint64(1) | (x[d] >> np.uint64(bit) & np.uint64(1))
    for shift in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(shift)
    return gray.astype(np.int64)
