"""Hashes: the 64-bit mixer with wrap-around arithmetic (safe under ANSI mode), ranks built on it, and a portable one.

The mixer is a chain of projections, each a short expression over the one before, so that it stays in generated code. Unsigned values travel as signed 64-bit numbers of the same bits; ``unsigned_order`` gives their order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# fixed values: the mixer's and the ranks' multipliers, the fallback rank's constant, the fingerprint's offset and prime
C1 = 0x9E3779B97F4A7C15
C2 = 0xBF58476D1CE4E5B9
C3 = 0x94D049BB133111EB
FALLBACK = 0xD6E8FEB86659FD93
OFFSET = 1469598103934665603
PRIME = 1099511628211


def signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def splitmix64(x: int) -> int:
    x = (x + C1) & MASK
    x = ((x ^ x >> 30) * C2) & MASK
    x = ((x ^ x >> 27) * C3) & MASK
    return x ^ x >> 31


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def wrap_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, for short a and b: each is used twice."""
    low = _low(a) + _low(b)
    return F.shiftleft(_high(a) + _high(b) + _high(low), 32).bitwiseOR(_low(low))


def wrap_mul(df: DataFrame, name: str, c: int) -> DataFrame:
    """Column ``name`` times c modulo 2**64, from products of 16 and 32 bits."""
    cl, ch, v = F.lit(c & 0xFFFFFFFF), F.lit(c >> 32), F.col(name)
    part = lambda k: F.shiftrightunsigned(v, 16 * k).bitwiseAND(F.lit(0xFFFF))
    df = df.withColumns({"_p0": part(0) * cl, "_p1": part(1) * cl, "_p2": part(2) * cl + part(0) * ch, "_p3": _low(part(3) * cl + part(1) * ch)})
    df = df.withColumn("_a", wrap_add(F.col("_p0"), F.shiftleft("_p1", 16)))
    df = df.withColumn("_b", F.shiftleft(_low(F.col("_p2")) + F.shiftleft(F.col("_p3").bitwiseAND(F.lit(0xFFFF)), 16), 32))
    return df.withColumn(name, wrap_add(F.col("_a"), F.col("_b"))).drop("_p0", "_p1", "_p2", "_p3", "_a", "_b")


def _fold(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, n)))


def splitmix(df: DataFrame, name: str) -> DataFrame:
    """Mix column ``name`` in place."""
    df = _fold(df.withColumn(name, wrap_add(F.col(name), F.lit(signed(C1)))), name, 30)
    df = _fold(wrap_mul(df, name, C2), name, 27)
    return _fold(wrap_mul(df, name, C3), name, 31)


def _rank(df: DataFrame, name: str, out: str, rest: int) -> DataFrame:
    df = wrap_mul(df.withColumn(out, (F.col(name) + 1).cast("long")), out, C1)
    return splitmix(df.withColumn(out, F.col(out).bitwiseXOR(F.lit(signed(rest)))), out)


def hash_rank(df: DataFrame, name: str, out: str, dim: int, iteration: int, seed: int) -> DataFrame:
    """Add ``out``: the rank of node ``name`` in one hash dimension."""
    return _rank(df, name, out, seed ^ (C2 * (dim + 1) & MASK) ^ (C3 * (iteration + 1) & MASK))


def fallback_rank(df: DataFrame, name: str, out: str, iteration: int, seed: int) -> DataFrame:
    return _rank(df, name, out, seed ^ (C2 * (iteration + 1) & MASK) ^ FALLBACK)


def overflow_rank(df: DataFrame, name: str, out: str, seed: int) -> DataFrame:
    return splitmix(df.withColumn(out, F.col(name).cast("long").bitwiseXOR(F.lit(signed(seed)))), out)


def dim_rank(dim: int, iteration: int, seed: int) -> int:
    return splitmix64(seed ^ (C1 * (dim + 1) & MASK) ^ (C2 * (iteration + 1) & MASK))


def dim_order(dims: int, iteration: int, seed: int) -> list[int]:
    return sorted(range(dims), key=lambda d: (dim_rank(d, iteration, seed), d))


def unsigned_order(x: Column) -> Column:
    """A signed key that orders like the unsigned number."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def portable_hash(x: Column, a: int = 48271, b: int = 12345) -> Column:
    """(a(x+1)+b) mod (2**31-1): the same in any SQL engine without overflow."""
    return (F.lit(a) * (x + 1) + F.lit(b)) % F.lit(2147483647)


def partition_hash(labels: Iterable[int]) -> int:
    """Fingerprint of the labels in node order."""
    h = OFFSET
    for x in labels:
        h = ((h ^ (x & 0xFFFFFFFF)) * PRIME) & MASK
    return h
