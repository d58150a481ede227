"""Vector arithmetic on array<float> columns, accumulated in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row.

    An expression used inside a lambda is otherwise evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length; null for null, 0 for empty."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Divided by the length; a zero vector is unchanged."""
    def divided(x: Column) -> Column:
        return let(norm(x), lambda n: F.when(n > 0, F.transform(x, lambda y: y / n)).otherwise(F.transform(x, lambda y: y.cast("double"))))

    return let(v, divided)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine, 0 when a length is 0 or the sizes differ.

    Lengths that are stored or the same for many rows are passed in, so they are
    not computed per pair.
    """
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def random_unit(seed: Column, dim: int) -> Column:
    """A random direction that depends on the seed alone: normalised normal components from hashes."""
    def uniform(i: Column, which: int) -> Column:
        return (F.pmod(F.xxhash64(seed, i, F.lit(which)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)

    normal = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(F.log(uniform(i, 0)) * -2) * F.cos(uniform(i, 1) * 6.283185307179586))
    return normalise(normal)


def cosine_shorter(a: Column, b: Column) -> Column:
    """Cosine over the components both vectors have."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))
