"""Column -> Column array and vector expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngrams(tokens, n: int, sep: str = " ") -> Column:
    """All n-grams of a token array, each joined with ``sep`` (tokens must not
    contain ``sep``; white-space-split tokens never contain a blank)."""
    t = _c(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                        lambda i: F.array_join(F.slice(t, i, n), sep))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def dot(a, b) -> Column:
    """Inner product in double precision, summed left to right."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """``v / max(||v||, eps)`` element-wise. The norm is computed once and
    zipped in (an outer expression inside a lambda would be re-evaluated for
    every element)."""
    v = _c(v)
    norm = F.array_repeat(F.greatest(l2_norm(v), F.lit(eps)), F.size(v))
    return F.zip_with(v, norm, lambda x, n: x.cast("double") / n)


def argmax_first(scores) -> Column:
    """0-based index of the maximum; the first index wins ties; NaN counts as
    the largest value (as in numpy and in Spark's ordering)."""
    s = _c(scores)
    return F.array_position(s, F.array_max(s)) - 1


def n_tied_max(scores) -> Column:
    """How many entries equal the maximum (degenerate vectors show up here)."""
    s = _c(scores)
    top = F.array_repeat(F.array_max(s), F.size(s))
    return F.size(F.filter(F.zip_with(s, top, lambda x, m: x == m), lambda b: b))
