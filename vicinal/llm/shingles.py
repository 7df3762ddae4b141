"""Word and shingle hashes of whole texts, vectorised over the bytes of many rows."""

from __future__ import annotations

import numpy as np

#: Bytes worked on at once; a longer row is a piece of its own.
PIECE = 1 << 20
_RNG = np.random.default_rng(5)
_LETTER = _RNG.integers(0, 2**64, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ROOT = 0x9E3779B97F4A7C15
_BACK = pow(_ROOT, -1, 2**64)
_PLACES = _RNG.integers(0, 2**63, 64, np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWER = [_powers(_ROOT, PIECE + 1), _powers(_BACK, PIECE + 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(at: np.ndarray):
    """Ranges of rows whose bytes fit into PIECE, or single longer rows."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some rows, and the offsets of each row's words. Words are runs of anything but ASCII white space; A-Z count as a-z."""
    global _POWER
    n = len(data)
    if n >= len(_POWER[0]):
        _POWER = [_powers(_ROOT, 2 * n), _powers(_BACK, 2 * n)]
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = inside & ~np.r_[False, inside[:-1]] | inside & edge[:-1]
    end = inside & (~np.r_[inside[1:], False] | edge[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * _POWER[0][:n], out=total[1:])
    return mix((total[e] - total[s]) * _POWER[1][s] + (e - s).astype(np.uint64)), np.searchsorted(s, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted set of its k-word shingles; with fewer words the whole sequence as one; without words nothing."""
    w, wat = words(data, at)
    runs = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        runs += w[j : j + len(runs)] * _PLACES[j]
    runs = mix(runs)
    out = []
    for a, b in zip(wat[:-1].tolist(), wat[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(runs[a : b - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            out.append(mix((w[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(w[:0])
    return out


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, without the planes that are all zero above the highest used one."""
    b = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, 8 - int(np.argmax(b.any(0)[::-1]))) if b.any() else 1
    return bytes([used]) + b[:, :used].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = planes[0].astype(np.uint64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return out
