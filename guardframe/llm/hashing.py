"""Hashes of the words of whole batches of texts, without a Python object for each word.

A word's hash is a polynomial of its bytes modulo 2**64, mixed; all words of a
stretch of text come from one running sum. Two different words have the same
hash with a probability of about 2**-64.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, split between words.
STRETCH = 1 << 17

_BASE = 0x9E3779B97F4A7C15
GOLD, _MIX = np.uint64(_BASE), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= GOLD
    x ^= x >> np.uint64(32)
    return x


def byte_values(inside: bytes) -> np.ndarray:
    """A number for each byte that words are made of, equal for A-Z and a-z, and 0 for all others."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * GOLD) | np.uint64(1)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[[b for b in range(256) if b not in inside]] = 0
    return table


@cache
def spaced() -> np.ndarray:
    """Words are runs of what isn't white space (0x20 and 0x09 to 0x0D)."""
    return byte_values(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))


@cache
def alphanumeric() -> np.ndarray:
    """Words are runs of ASCII digits and letters and of what isn't ASCII."""
    return byte_values(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum()))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(1 << bits, base, dtype=np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


def _stretch(data: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in some bytes; a word also begins at each of ``firsts``."""
    values = table[data]
    inside = values != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[firsts] = inside[firsts]
    at = np.flatnonzero(starts)
    if not at.size:
        return at, np.zeros(0, dtype=np.uint64)
    ends = np.append(at[1:], data.size)  # what lies between adds nothing
    up, down = _powers(max(18, int(data.size).bit_length()))
    values *= up[: data.size]
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return at, mixed((sums[ends] - sums[at]) * down[at])


def word_hashes(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words after lower-casing A-Z, and where each text begins among them
    (the number of words last). Null texts have none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    firsts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    places, hashes, at = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], 0
    while at < data.size:
        stop = min(data.size, at + STRETCH)
        while stop < data.size:  # to the end of a word
            outside = np.flatnonzero(table[data[stop : stop + 4096]] == 0)
            stop = stop + int(outside[0]) if outside.size else min(data.size, stop + 4096)
            if outside.size:
                break
        own = firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, stop)] - at
        found, said = _stretch(data[at:stop], own, table)
        places.append(found + at)
        hashes.append(said)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)
