"""Array columns as vectors: packing, lengths, block norms, products, tolerances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-12


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside a lambda an outer expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, scale: float = 1.0) -> Column:
    """The vector over its length plus 1e-12, times ``scale``; a zero vector stays zero."""
    return _let(a, lambda v: _let(length(v) + ZERO, lambda n: F.transform(v, lambda x: x.cast("double") / n * scale)))


def padded(a: Column, width: int) -> Column:
    """``width`` values: cut or filled with zeros; a null array is all zeros."""
    filled = F.concat(F.coalesce(a, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), width))
    return F.slice(filled, 1, width)


def packed(blocks: dict[str, int]) -> Column:
    """Blocks one after the other, each of its width."""
    return F.concat(*[padded(F.col(c), w) for c, w in blocks.items()])


def block_normed(blocks: dict[str, int], weight: str = "equal") -> Column:
    """Blocks of length one, weighted equally or by one over the root of their width, joined and of length one."""
    scale = {c: 1.0 if weight == "equal" else w**-0.5 for c, w in blocks.items()}
    return unit(F.concat(*[unit(padded(F.col(c), w), scale[c]) for c, w in blocks.items()]))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def rounded_hash(a: Column, digits: int = 3) -> Column:
    """SHA-256 of a vector's rounded values; equal classes, but not the bytes, of a hash over the binary values."""
    return F.sha2(F.array_join(F.transform(a, lambda x: F.round(x, digits).cast("string")), ","), 256)
