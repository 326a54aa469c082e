"""Words of many texts as flat numpy arrays: places, 64-bit hashes, hashes of runs of words."""

from __future__ import annotations

import numpy as np

_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Enough for a slice of text; longer texts get theirs made for them.
_KEPT_POWERS = (1 << 20) + 4096
_powers: dict[int, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of MurmurHash3)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _KEPT_POWERS)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if size == _KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def places(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text (and the end) the number of words before it."""
    n = len(data)
    inside = ~gap[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    begins, ends = offsets[:-1], offsets[1:]
    filled = ends > begins
    before[begins[filled]] = False
    after[ends[filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial over random byte values, then mixed."""
    terms = _BYTE[data] * _powers_of(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    span = (sums[stops] - sums[starts]) * _powers_of(_INVERSE, len(data) + 1)[starts]
    return mixed(span + (stops - starts).astype(np.uint64))


def spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each span of values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers_of(_BASE, len(values)), out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * _powers_of(_INVERSE, len(values) + 1)[starts] + (stops - starts).astype(np.uint64))


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values (over the ends of texts too; the caller drops those)."""
    n = max(0, len(values) - k + 1)
    out = values[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[j : j + n]
    return mixed(out)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest, the first of equal ones."""
    place = np.arange(len(values))
    low, at, have = values, place, 1
    while have < width:
        step = min(have, width - have)
        n = len(low) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        right = low[step:] < low[:n]
        at = np.where(right, at[step:], at[:n])
        low = np.where(right, low[step:], low[:n])
        have += step
    return at
