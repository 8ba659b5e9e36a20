"""Minimal perfect hashing of 128-bit keys: hash, displace, and place single keys directly."""

from __future__ import annotations

import numpy as np

_DIRECT = np.uint32(0x80000000)
_U = np.uint64
#: Keys in a group on average; more save pilots and cost build time.
KEYS_PER_GROUP = 4


def _mix(h1: np.ndarray, h2: np.ndarray, pilot: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 + pilot.astype(_U) * _U(0x9E3779B97F4A7C15))
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _groups(h1: np.ndarray, n: int) -> np.ndarray:
    return ((h1 >> _U(20)) % _U(n)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots (uint32) and the slot of each key: a bijection onto 0..n-1."""
    n = len(h1)
    m = max(1, -(-n // KEYS_PER_GROUP))
    pilots, slots = np.zeros(m, np.uint32), np.empty(n, np.int64)
    group = _groups(h1, m)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=m)
    ends = np.cumsum(counts)
    taken = np.zeros(n, bool)
    by_size = np.argsort(-counts, kind="stable")
    for g in by_size[: int((counts > 1).sum())]:
        own = order[ends[g] - counts[g] : ends[g]]
        a, b, first, step = h1[own][None, :], h2[own][None, :], 0, 32
        while True:
            tries = np.arange(first, first + step, dtype=np.int64)[:, None]
            got = np.sort(where := (_mix(a, b, tries) % _U(n)).astype(np.int64), axis=1)
            fit = ~taken[where].any(axis=1) & (got[:, 1:] != got[:, :-1]).all(axis=1)
            if fit.any():
                k = int(fit.argmax())
                pilots[g], slots[own] = first + k, where[k]
                taken[where[k]] = True
                break
            first, step = first + step, min(4096, step * 2)
            if first > 1 << 24:
                raise ValueError("two keys have the same 128-bit hash")
    alone = by_size[int((counts > 1).sum()) : int((counts > 0).sum())]
    free = np.flatnonzero(~taken)
    pilots[alone] = free.astype(np.uint32) | _DIRECT
    slots[order[ends[alone] - 1]] = free
    return pilots, slots


def lookup(h1: np.ndarray, h2: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slots of the keys; a key that was not built gets some slot, which its fingerprint refutes."""
    if n == 0:
        return np.full(len(h1), -1, np.int64)
    pilot = pilots[_groups(h1, len(pilots))]
    direct = (pilot & _DIRECT) != 0
    hashed = (_mix(h1, h2, pilot) % _U(n)).astype(np.int64)
    return np.where(direct, (pilot & ~_DIRECT).astype(np.int64), hashed)


def fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2 >> _U(32)).astype(np.uint32)
