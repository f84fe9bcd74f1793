"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WIDTH = 5
_KNOWN_WORDS = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class WordHashes(dict):
    """64-bit hash per word; forgets everything when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def odd_constants(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES = odd_constants(WIDTH, 5)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer
    words than a shingle has make one shingle of the whole sequence; no words
    make an empty set.
    """
    words = text.encode().translate(_LOWER).split() if text else ()
    count = len(words)
    if not count:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, count)
    width = min(WIDTH, count)
    total = np.full(count - width + 1, width, np.uint64)
    for place in range(width):
        total += hashes[place : count - width + 1 + place] * _PLACES[place]
    return np.unique(_mixed(total))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that name the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def in_bunches(sets: Iterable[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """Consecutive sets, cut before they hold more than ``most`` hashes together."""
    bunch: list[np.ndarray] = []
    size = 0
    for one in sets:
        if bunch and size + len(one) > most:
            yield bunch
            bunch, size = [], 0
        bunch.append(one)
        size += len(one)
    if bunch:
        yield bunch
