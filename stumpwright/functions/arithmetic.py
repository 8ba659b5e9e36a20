"""Deterministic integer hashing and rounding shared by samplers and generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 2147483648


def lcg(c: Column, a: int = 69069, b: int = 1) -> Column:
    """One step of a linear congruential generator modulo 2^31 on a BIGINT."""
    return F.pmod(F.pmod(c.cast("bigint"), F.lit(_M)) * F.lit(a).cast("bigint") + F.lit(b), F.lit(_M))


def chain(c: Column, steps: int, seed: int = 0) -> Column:
    """Hash of an integer key: ``steps`` generator steps, the first one strong, after adding the seed."""
    out = lcg(F.pmod(c.cast("bigint"), F.lit(_M)) + F.lit(seed), 1103515245, 12345)
    for _ in range(steps - 1):
        out = lcg(out)
    return out


def sample_order(key: Column, seed: int = 0) -> Column:
    """Sort key that stands for a random order; low bits, which are patterned, are dropped."""
    return F.floor(chain(key, 3, seed) / F.lit(64))


def half_even(x: Column) -> Column:
    """Python's round(): ties to the even integer."""
    return F.bround(x).cast("bigint")


def guarded(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b with a defined result for b = 0 (``otherwise``; None gives NULL)."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if otherwise is None else F.coalesce(q, F.lit(otherwise))
