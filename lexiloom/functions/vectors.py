"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

import struct

from pyspark.sql import Column, functions as F


def dot(v: Column, q: list[float] | Column) -> Column:
    """The dot product, kept within [-1, 1]."""
    q = F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, list) else q
    s = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def valid(v: Column, dims: int, tolerance: float = 1e-4) -> Column:
    """Finite, of unit length, with so many dimensions."""
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dims) & finite & (F.abs(norm(v) - 1) <= tolerance)


def packed(v: list[float]) -> bytes:
    """32-bit little-endian, as vectors are stored and hashed."""
    return struct.pack(f"<{len(v)}f", *v)
