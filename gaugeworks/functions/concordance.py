"""Concordant minus discordant pairs of weighted points, by merge counting in arrays."""

from __future__ import annotations

import numpy as np


def concordance(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Sum over all pairs of points of the product of their weights and the signs of their differences in x and y.

    Points are in the order of x. From the highest bit of the y ranks on, the points of a block, which agree in all
    higher bits, are split by the bit: those with a 0 lie below those with a 1, so running sums count the pairs
    that differ first in that bit. Equal x share the running sum before the first of them. Each bit is one pass, and
    the split is stable, so nothing is sorted again.
    """
    if len(x) < 2:
        return 0.0
    order = np.argsort(x, kind="stable")
    x, weight = x[order], np.asarray(weight, float)[order]
    levels, rank = np.unique(y[order], return_inverse=True)
    at = np.arange(len(x))
    total = 0.0
    for bit in range(int(len(levels) - 1).bit_length() - 1, -1, -1):
        block, high = rank >> (bit + 1), (rank >> bit) & 1 == 1
        new_block = np.ones(len(x), bool)
        new_block[1:] = block[1:] != block[:-1]
        new_run = new_block.copy()
        new_run[1:] |= x[1:] != x[:-1]
        begin = np.maximum.accumulate(np.where(new_block, at, 0))
        run = np.maximum.accumulate(np.where(new_run, at, 0))
        upper = np.where(high, weight, 0.0)
        before_high = np.concatenate(([0.0], np.cumsum(upper)))
        before_low = np.concatenate(([0.0], np.cumsum(weight - upper)))
        total += float((upper * (before_low[run] - before_low[begin])).sum() - ((weight - upper) * (before_high[run] - before_high[begin])).sum())
        # Zeros of a block come first, in their order, then the ones.
        zeros = np.concatenate(([0], np.cumsum(~high)))
        end = np.append(at[new_block][1:], len(x))[np.cumsum(new_block) - 1]
        low_before, low_all = zeros[:-1] - zeros[begin], zeros[end] - zeros[begin]
        place = np.where(high, at + low_all - low_before, begin + low_before)
        x2, rank2, weight2 = np.empty_like(x), np.empty_like(rank), np.empty_like(weight)
        x2[place], rank2[place], weight2[place] = x, rank, weight
        x, rank, weight = x2, rank2, weight2
    return total
