"""Encoding costs as Column expressions; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capacity(sa: Column, sb: Column, internal: Column | bool = False) -> Column:
    """Node pairs of a block: s(s-1)/2 inside a supernode, sa*sb across."""
    inside = F.shiftright(sa * (sa - 1), 1)
    if isinstance(internal, bool):
        return inside if internal else sa * sb
    return F.when(internal, inside).otherwise(sa * sb)


def block_cost(sa: Column, sb: Column, edges: Column, internal: Column | bool = False) -> Column:
    """min(e, 1 + capacity - e): list the edges, or one superedge and the missing ones."""
    return F.least(edges, F.lit(1) + capacity(sa, sb, internal) - edges)


def checked_block_cost(sa: Column, sb: Column, edges: Column, internal: Column | bool = False) -> Column:
    """block_cost() that raises for a count below zero or above the capacity."""
    bad = (edges < 0) | (edges > capacity(sa, sb, internal))
    return F.when(bad, F.raise_error(F.lit("edge count exceeds block capacity")).cast("long")).otherwise(block_cost(sa, sb, edges, internal))


def safe_ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def log2_floor(x: Column) -> Column:
    """floor(log2(x)) of a positive integer without floating point; 0 for x <= 0."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).otherwise(F.lit(0))
