"""Vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where either is a zero vector."""
    n = F.least(F.size(a), F.size(b))
    square = lambda v: F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda s, x: s + x * x)
    norm = F.sqrt(square(a) * square(b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def cosine_first(a: Column, b: Column) -> Column:
    """Over the first one's length: NaN where the second is shorter; product of roots in the denominator."""
    norms = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) for v in (a, F.slice(b, 1, F.greatest(F.size(a), F.lit(1))))]
    return F.when(F.size(b) < F.size(a), F.lit(float("nan"))).when(norms[0] * norms[1] == 0, F.lit(0.0)).otherwise(dot(a, b) / (norms[0] * norms[1]))


def pooled(tokens: Column, how: str = "mean", normalize: bool = False) -> Column:
    """One vector of a text's token vectors (array<array<double>>): their mean, their maxima, or the first ("cls"); null without any."""
    if how == "cls":
        out = F.get(tokens, F.lit(0))
    else:
        entry = lambda i: F.transform(tokens, lambda t: F.get(t, i))
        one = (lambda i: F.aggregate(entry(i), F.lit(0.0), lambda s, x: s + x) / F.size(tokens)) if how == "mean" else (lambda i: F.array_max(entry(i)))
        out = F.transform(F.sequence(F.lit(0), F.size(F.get(tokens, F.lit(0))) - 1), one)
    if normalize:
        norm = F.sqrt(F.aggregate(out, F.lit(0.0), lambda s, x: s + x * x))
        out = F.transform(out, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))
    return F.when(F.size(tokens) > 0, out)
