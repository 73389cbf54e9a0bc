"""Bucket numbers against literal bounds, for any number of bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_less_array(x: Column, bounds: list, closed: bool = False) -> Column:
    """Number of the sorted ``bounds`` below ``x`` (``closed``: at or below), for any
    number of bounds: a block of about sqrt(n) of them is found first, then
    searched, so a row costs 2 sqrt(n) comparisons and the expression stays small."""
    if not bounds:
        return F.lit(0)
    return count_less_arrays(x, F.lit(bounds), F.lit(block_ends(bounds)), block_size(bounds), closed)


def block_size(bounds: list) -> int:
    return max(1, int(len(bounds) ** 0.5))


def block_ends(bounds: list) -> list:
    return bounds[block_size(bounds) - 1::block_size(bounds)]


def count_less_arrays(x: Column, every: Column, ends: Column, size: int | Column,
                      closed: bool = False) -> Column:
    """As :func:`count_less_array` with the bounds, the last bound of every block and
    the block size as columns."""
    size = F.lit(size) if isinstance(size, int) else size
    below = (lambda b: b <= x) if closed else (lambda b: b < x)
    blocks = F.size(F.filter(ends, below))
    rest = F.slice(every, blocks * size + 1, size)
    return blocks * size + F.size(F.filter(rest, below))
