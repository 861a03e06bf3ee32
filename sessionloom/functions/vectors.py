"""Vector columns (VEC-1, SRC-13)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """0 when a norm is 0; vectors of unequal length raise."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine with one query vector, whose norm is computed once on the driver."""
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    if length == 0:
        return F.lit(0.0)
    q = F.array(*[F.lit(float(x)) for x in query])
    n = norm(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, q) / (n * length))


def hashed_embedding(tokens: Column, dimensions: int = 64) -> Column:
    """Signed feature hashing of a token array to a unit vector: the offline embedding provider, in plain column expressions.

    A token's hash is its place, with a sign; one fold over the tokens adds them up.
    """
    return unit(_folded(F.transform(tokens, lambda t: place(t, dimensions)), dimensions, lambda p: F.signum(p.cast("double"))))


def place(token: Column, dimensions: int) -> Column:
    """Dimension of a token, from 1, negative for tokens that count against it."""
    at = F.pmod(F.xxhash64(token), F.lit(dimensions)).cast("int") + 1
    return F.when(F.pmod(F.xxhash64(F.lit(1), token), F.lit(2)) == 0, at).otherwise(-at)


def _folded(items: Column, dimensions: int, value, at=lambda x: x) -> Column:
    """Sum of ``value(item)`` by dimension ``abs(at(item))``, in one pass."""

    def step(a, x):
        i = F.abs(at(x))
        return F.concat(F.slice(a, 1, i - 1), F.array(F.get(a, i - 1) + value(x)), F.slice(a, i + 1, F.lit(dimensions)))

    return F.aggregate(items, F.array_repeat(F.lit(0.0), dimensions), step)


def unit(v: Column) -> Column:
    """``v`` with length 1; zero vectors stay."""
    # bound as a lambda variable, so that it is computed once
    return F.get(F.transform(F.array(v), lambda raw: F.get(F.transform(F.array(norm(raw)), lambda n: F.when(n == 0, raw).otherwise(F.transform(raw, lambda x: x / n))), F.lit(0))), F.lit(0))
