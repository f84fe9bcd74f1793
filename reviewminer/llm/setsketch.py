"""SetSketch registers: exponentially spaced, truncated minima of hashed sets.

A register holds floor(1 - log_b(x / a)) for the minimum x of exponential
variates over the set. The minimum of a union is the minimum of the minima, so
sketches merge by the larger register. Two sketches of sets with known sizes
give the Jaccard similarity by maximum likelihood over how many registers are
larger, smaller and equal.
"""

from __future__ import annotations

import numpy as np

from .shingles import odd_constants

BASE = 1.001  # so fine that registers of different minima are seldom equal
RATE = 20.0
LARGEST = 65_534  # registers fit 16 bits
BAND = 5
BANDS = 40
REGISTERS = BAND * BANDS
_SEED = 7
_GRID = np.concatenate([np.linspace(0.0, 0.7, 8), np.linspace(0.75, 1.0, 11)])


def multipliers() -> np.ndarray:
    return odd_constants(REGISTERS, _SEED)


def registers(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """One row of 16-bit registers for each non-empty set."""
    hashes = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(factors), len(sets)), np.uint64)
    product = np.empty_like(hashes)
    for row, factor in zip(least, factors, strict=True):
        np.multiply(hashes, factor, out=product)
        np.minimum.reduceat(product, starts, out=row)
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53))
    steps = np.floor(1.0 - np.log(exponential / RATE) / np.log(BASE))
    return np.clip(steps, 0, LARGEST + 1).astype("<u2")


def merged(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(first, second)


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that the first register is larger, by its share of the union."""
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)


def likelihoods(larger, smaller, equal, size, other_size, grid: np.ndarray = _GRID) -> np.ndarray:
    """Log-likelihood of every similarity in the grid (last axis); -inf where sizes rule it out."""
    u = (size / (size + other_size))[..., None]
    v = 1.0 - u
    up, down = _share(u - v * grid), _share(v - u * grid)
    possible = (u >= v * grid - 1e-12) & (v >= u * grid - 1e-12)
    tiny = 1e-300
    found = (
        larger[..., None] * np.log(np.maximum(up, tiny))
        + smaller[..., None] * np.log(np.maximum(down, tiny))
        + equal[..., None] * np.log(np.maximum(1.0 - up - down, tiny))
    )
    return np.where(possible, found, -np.inf)


def compared(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of larger, smaller and equal registers for every row against every other."""
    shape = (len(rows), len(others))
    larger, equal = np.empty(shape), np.empty(shape)
    for i, row in enumerate(rows):
        larger[i] = (row > others).sum(axis=1)
        equal[i] = (row == others).sum(axis=1)
    return larger, rows.shape[1] - larger - equal, equal


def may_reach(larger, smaller, equal, size, other_size, threshold: float, slack: float = 12.5) -> np.ndarray:
    """Whether a similarity of the threshold or more is likely enough to be verified.

    ``slack`` is a log-likelihood ratio; 12.5 is five standard deviations.
    """
    values = likelihoods(larger, smaller, equal, size, other_size)
    reach = values[..., _GRID >= threshold - 1e-9].max(axis=-1)
    return np.isfinite(reach) & (reach >= values.max(axis=-1) - slack)
