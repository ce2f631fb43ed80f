"""Vectorised tokens and 64-bit hashes over the joined bytes of many texts."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: Bytes of alphanumeric tokens; all bytes of non-ASCII characters count as letters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Odd, so it can be inverted modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 19
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _byte_values(lower: bool) -> np.ndarray:
    values = _mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if lower:
        values[65:91] = values[97:123]
    return values


_POWERS = np.cumprod(np.concatenate([np.ones(1, _U), np.full(_BLOCK, _BASE, _U)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, _U), np.full(_BLOCK, pow(_BASE, -1, 1 << 64), _U)]))
_VALUES = {x: _byte_values(x) for x in (False, True)}


def spans(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes within each text, and the first run of each text (the count last)."""
    inside = member[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span, the same wherever it stands; spans must be sorted by start. Works block by block."""
    out = np.zeros(len(starts), _U)
    values, at = _VALUES[lower], 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, lo + _BLOCK // 2)))
        hi = int(stops[at:to].max())
        if hi - lo > _BLOCK:  # a span longer than a block stands alone
            small = stops[at:to] - lo <= _BLOCK
            if not small[0]:
                out[at] = _long_hash(buf[lo : stops[at]], values)
                at += 1
                continue
            to = at + int(np.argmin(small))
            hi = int(stops[at:to].max())
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(values[buf[lo:hi]] * _POWERS[: hi - lo])])
        out[at:to] = (sums[stops[at:to] - lo] - sums[starts[at:to] - lo]) * _INVERSE[starts[at:to] - lo]
        at = to
    return _mix(out + (stops - starts).astype(_U) * _U(0xA24BAED4963EE407))


def _long_hash(piece: np.ndarray, values: np.ndarray) -> np.uint64:
    total, power = 0, 1
    for lo in range(0, len(piece), _BLOCK):
        part = values[piece[lo : lo + _BLOCK]]
        total = (total + int((part * _POWERS[: len(part)]).sum(dtype=_U)) * power) % (1 << 64)
        power = power * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return _U(total)


def windows(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text, a shorter text's words as one run; and how many runs each text has."""
    count = np.diff(first)
    runs = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    factors = [_U(int(x)) for x in _mix(np.arange(1, n + 1, dtype=_U)) | _U(1)]
    total = len(word)
    full = np.zeros(total, _U)
    for i in range(min(n, total)):
        full[: total - i] += word[i:] * factors[i]
    begin = np.repeat(first[:-1], runs) + (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    out = full[begin] + _U(n)
    at = np.cumsum(runs) - runs
    for t in np.flatnonzero((count > 0) & (count < n)):
        mine = word[first[t] : first[t + 1]]
        out[at[t]] = (mine * np.array(factors[: len(mine)], _U)).sum(dtype=_U) + np.full(1, count[t], _U)[0]
    return _mix(out), runs
