"""XXH64 of many byte strings at once, as numpy arrays (public algorithm; fixed constants)."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of ``data[start[i]:start[i] + length[i]]`` for each i."""
    data = data + bytes(8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    one = np.frombuffer(data, np.uint8)
    seed, at, end = np.uint64(seed), start.astype(np.int64), (start + length).astype(np.int64)
    h = np.full(len(at), seed + P5)
    big = np.flatnonzero(length >= 32)
    if len(big):
        with np.errstate(over="ignore"):
            v = [np.full(len(big), x) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        todo = np.arange(len(big))
        pos, stop = at[big], end[big]
        while len(todo):
            for k in range(4):
                v[k][todo] = _round(v[k][todo], eight[pos[todo] + 8 * k])
            pos[todo] += 32
            todo = todo[pos[todo] + 32 <= stop[todo]]
        acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for k in range(4):
            acc = (acc ^ _round(np.zeros_like(acc), v[k])) * P1 + P4
        h[big], at[big] = acc, pos
    h += length.astype(np.uint64)
    while len(todo := np.flatnonzero(at + 8 <= end)):
        h[todo] = _rot(h[todo] ^ _round(np.zeros(len(todo), np.uint64), eight[at[todo]]), 27) * P1 + P4
        at[todo] += 8
    todo = np.flatnonzero(at + 4 <= end)
    h[todo] = _rot(h[todo] ^ four[at[todo]].astype(np.uint64) * P1, 23) * P2 + P3
    at[todo] += 4
    while len(todo := np.flatnonzero(at < end)):
        h[todo] = _rot(h[todo] ^ one[at[todo]].astype(np.uint64) * P5, 11) * P1
        at[todo] += 1
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)
