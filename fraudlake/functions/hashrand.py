"""Portable, partitioning-independent randomness.

``rand()`` depends on partition layout and is not reproducible after a
recomputation. These expressions derive a uniform number from a stable
identifier and a seed with md5, so Spark and DuckDB produce identical draws.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(*parts, seed) -> Column:
    """u in (0, 1): (first 32 bits of md5(id ':' seed) + 0.5) / 2^32."""
    key = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts],
                      F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(TWO_32)


def uniform_sql(parts_sql: list[str], seed) -> str:
    """DuckDB twin of :func:`uniform` (parts are SQL expressions)."""
    inner = " || ':' || ".join(f"cast({p} as varchar)" for p in parts_sql)
    return (f"((('0x' || substr(md5({inner} || ':' || '{seed}'), 1, 8))::bigint + 0.5)"
            f" / {TWO_32})")


def normal_pair(u1: Column, u2: Column) -> Column:
    """Standard normal draw by Box-Muller from two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def poisson_table(lam):
    """(k0, CDF at k0, k0 + 1, ...) of a Poisson variable: a draw is k0 plus the number of CDF
    values below the uniform. For large means the table starts 14 standard deviations below
    the mean (less probability than a double can add), with the first term from logs."""
    first = max(0, math.floor(lam - 14 * math.sqrt(lam))) if lam > 600 else 0
    last = math.floor(lam + 14 * math.sqrt(lam) + 40)
    start = math.exp(first * math.log(lam) - lam - math.lgamma(first + 1)) if first else math.exp(-lam)
    steps = lam / np.arange(first + 1, last + 1)
    return first, np.cumsum(np.concatenate([[start], start * np.cumprod(steps)]))[:-1]


def _poisson_quantile(lam, u):
    """Poisson draws from uniforms, element by element."""
    lam, u = np.asarray(lam, dtype="float64"), np.asarray(u, dtype="float64")
    out = np.zeros(len(lam), dtype="int64")
    for x in np.unique(lam[lam > 0]):
        first, cdf = poisson_table(float(x))
        out[lam == x] = first + np.searchsorted(cdf, u[lam == x], side="left")
    return out
