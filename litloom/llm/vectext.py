"""Whole batches of texts as arrays: code points, words and their hashes, without a loop over characters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """0 for separators, 1 for letters and digits, 2 for characters that are words by themselves (CJK)."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3040):
        table[c] = chr(c).isalnum()
    table[0x3040:0x31F0] = 2
    table[0x3400:0xA000] = 2
    for c in range(0xA000, 0xD7B0):
        table[c] = chr(c).isalnum()
    table[0xF900:0xFB00] = 2
    for c in range(0xFB00, 0x20000):
        table[c] = chr(c).isalnum() if not 0xD800 <= c < 0xE000 else 0
    table[0x20000:0x32000] = 2
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text begins (one more entry than texts)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.concatenate(([0], np.cumsum(lengths)))


class Words:
    """The words of a batch: hash, first and one-past-last code point, and the first word of each text."""

    __slots__ = ("hashes", "starts", "ends", "firsts")

    def __init__(self, hashes, starts, ends, firsts):
        self.hashes, self.starts, self.ends, self.firsts = hashes, starts, ends, firsts


def words(texts: list[str]) -> Words:
    """Words of the texts: runs of letters and digits in lower case; a CJK character is a word."""
    texts = [t.lower() for t in texts]
    cps, offsets = code_points(texts)
    n = len(cps)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), none, none, np.zeros(len(texts) + 1, np.int64))
    cls = char_classes()[cps]
    inside = cls > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (cls[1:] == 2) | (cls[:-1] == 2)
    border = offsets[1:-1]
    border = border[border < n]
    starts[border] |= inside[border]
    at = np.flatnonzero(starts)
    if len(at) == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, _U), none, none, np.zeros(len(texts) + 1, np.int64))
    counts = np.cumsum(inside)
    total = np.append(counts[at[1:] - 1], counts[-1]) - (counts[at] - 1)
    position = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)), axis=0)[: n - at[0]] if at[0] == 0 else None
    if position is None:
        position = np.zeros(n, np.int64)
        position[at[0] :] = np.arange(at[0], n) - np.repeat(at, np.diff(np.append(at, n)))
    powers = np.empty(int(total.max()) + 1, _U)
    powers[0] = 1
    for i in range(1, len(powers)):
        powers[i] = (int(powers[i - 1]) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
    np.minimum(position, len(powers) - 1, out=position)
    values = (cps.astype(_U) + _U(1)) * powers[position]
    values[~inside] = 0
    return Words(mix(np.add.reduceat(values, at)), at, at + total, np.searchsorted(at, offsets))
