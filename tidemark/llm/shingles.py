"""Word shingles of many texts at once, as 64-bit hashes, and their minwise signatures."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import GOLDEN, mix64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
BASE = (0x100000001B3 * 0x9E3779B1 | 1) % 2**64


def word_hashes(raw: np.ndarray, bounds: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run of bytes other than those of `apart`, ASCII white space if not given; A-Z lower-cased) and the text it is of."""
    keep = ~apart[raw]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    start[edges] = keep[edges]
    at = np.flatnonzero(keep)
    first = np.flatnonzero(start[at])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(at)))
    powers = np.full(int(sizes.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(at)) - np.repeat(first, sizes)
    sums = np.add.reduceat((LOWER[raw[at]] + np.uint64(1)) * powers[place], first)
    return mix64(sums + sizes.astype(np.uint64) * np.uint64(GOLDEN)), np.searchsorted(bounds, at[first], "right") - 1


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, in order. A text of fewer words has its whole sequence as one; a text without words none."""
    words, owner = word_hashes(raw, bounds)
    count = np.bincount(owner, minlength=len(bounds) - 1)
    ends = np.cumsum(count)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix64(rolled * np.uint64(BASE) + words[k : k + len(rolled)])
    out = []
    for n, end in zip(count.tolist(), ends.tolist()):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            one = np.zeros(1, np.uint64)
            for w in words[end - n : end]:
                one = mix64(one * np.uint64(BASE) + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signatures:
    """Minwise values of a set under `count` hash functions: 32-bit tokens of the first ones, and two bits of each, all low bits first."""

    def __init__(self, count: int = 256, tokens: int = 64, seed: int = 1):
        keys = mix64((np.arange(2 * count, dtype=np.uint64) + np.uint64(seed * 1000003)) * np.uint64(GOLDEN))
        self.flip, self.scale, self.tokens = keys[:count, None], keys[count:, None] | np.uint64(1), tokens

    def of(self, found: np.ndarray) -> tuple[bytes, bytes]:
        least = None
        for k in range(0, len(found), 512):
            part = ((found[k : k + 512] ^ self.flip) * self.scale).min(1)
            least = part if least is None else np.minimum(least, part)
        mixed = mix64(least)
        return (mixed[: self.tokens] >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(np.concatenate([mixed & np.uint64(1), mixed >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)).tobytes()
