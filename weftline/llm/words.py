"""Words of many texts at once, as 64-bit hashes over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

from .common import mix64

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z hash as a-z
BASE = np.uint64(0x5DEECE66D5DEECE7)
COEFFICIENT = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i under n."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            x = np.full(max(n, 1 << 19), b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true bytes; a run ends where its text ends."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run, A-Z as a-z."""
    p, inverse = powers(len(raw) + 1)
    h = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * p[:-1], out=h[1:])
    return mix64((h[ends] - h[starts]) * inverse[starts])


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of width words; with fewer words, one of them all; without words, none."""
    starts, ends = runs(~SPACES[raw], offsets)
    w = hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)
    out = []
    all_of = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        all_of += w[k : k + len(all_of)] * COEFFICIENT[k]
    all_of = mix64(all_of)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(all_of[a : b - width + 1]))
        elif b > a:
            out.append(mix64(np.array([(w[a:b] * COEFFICIENT[width : width + b - a]).sum(dtype=np.uint64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
