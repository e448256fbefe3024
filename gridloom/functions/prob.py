"""Probability algebra as column expressions.

A value is a double, an array of doubles (one entry per failure probability), a
polynomial in p (coefficients from the constant up) or a polynomial in the
basis p^i (1-p)^(d-i). All operations are built-in higher-order functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pad(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def poly_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _pad(x) + _pad(y))


def poly_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _pad(x) - _pad(y))


def poly_scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def poly_mul(a: Column, b: Column, max_degree: int | None = None) -> Column:
    """Convolution; with ``max_degree`` the higher powers are dropped (at most so many failures)."""
    top = F.size(a) + F.size(b) - F.lit(2)
    if max_degree is not None:
        top = F.least(top, F.lit(max_degree))

    def term(k: Column) -> Column:
        low, high = F.greatest(F.lit(0), k - F.size(b) + F.lit(1)), F.least(k, F.size(a) - F.lit(1))
        return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, i: acc + F.get(a, i) * F.get(b, k - i))

    return F.transform(F.sequence(F.lit(0), top), term)


def poly_eval(a: Column, p: Column) -> Column:
    """Horner's rule."""
    return F.aggregate(F.reverse(a), F.lit(0.0), lambda acc, c: acc * p + c)


def poly_trim(a: Column) -> Column:
    """Without zeros at the end; the zero polynomial keeps one coefficient."""
    last = F.aggregate(F.transform(a, lambda c, i: F.when(c != 0, i).otherwise(-1)), F.lit(0), lambda acc, i: F.greatest(acc, i))
    return F.slice(a, 1, last + 1)


def poly_is_zero(a: Column) -> Column:
    return F.forall(a, lambda c: c == 0)


def poly_pow(a: Column, k: Column) -> Column:
    """``a`` to a whole power of 0 or more."""
    times = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(times, F.array(F.lit(1.0)), lambda acc, _: poly_mul(acc, a))


def poly_divmod(a: Column, b: Column) -> Column:
    """``struct(quotient, remainder)`` by long division; null where ``b`` is zero."""
    a, b = poly_trim(a), poly_trim(b)
    na, nb = F.size(a) - F.lit(1), F.size(b) - F.lit(1)
    start = F.struct(F.array().cast("array<double>").alias("quotient"), a.alias("remainder"))

    def step(acc: Column, k: Column) -> Column:
        c = F.get(acc["remainder"], k + nb) / F.get(b, nb)
        rest = F.transform(acc["remainder"], lambda x, j: x - F.when((j >= k) & (j <= k + nb), c * F.get(b, j - k)).otherwise(0.0))
        return F.struct(F.concat(F.array(c), acc["quotient"]).alias("quotient"), rest.alias("remainder"))

    places = F.when(na >= nb, F.reverse(F.sequence(F.lit(0), na - nb))).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(places, start, step)
    quotient = F.when(na >= nb, done["quotient"]).otherwise(F.array(F.lit(0.0)))
    remainder = F.when(nb == 0, F.array(F.lit(0.0))).when(na >= nb, F.slice(done["remainder"], 1, nb)).otherwise(a)
    return F.when(~poly_is_zero(b), F.struct(quotient.alias("quotient"), remainder.alias("remainder")))


def _real_roots(coefficients: pd.Series) -> pd.Series:
    def one(c) -> list[float]:
        c = np.trim_zeros(np.asarray(c, dtype=float)[::-1], "f")
        found = np.roots(c) if len(c) > 1 else np.zeros(0)
        return sorted(float(x.real) for x in found if abs(x.imag) <= 1e-9 * max(1.0, abs(x)))

    return coefficients.map(one)


def real_roots(a: Column) -> Column:
    """The real roots in order, a double one twice; none for a constant. Eigenvalues of the companion matrix, in Arrow batches."""
    return F.pandas_udf(_real_roots, "array<double>")(a)


def root_rows(df: DataFrame, a: Column, name: str = "root") -> DataFrame:
    """A row for each real root of the polynomial ``a``. The optimizer would move a Python column into a generator, so the rows come from the batches themselves."""

    def run(batches):
        for b in batches:
            out = b.assign(**{name: _real_roots(b[name])}).explode(name)
            yield out[out[name].notna()].astype({name: float})

    kept = df.withColumn(name, a)
    schema = ", ".join(f"`{f.name}` {'double' if f.name == name else f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, schema)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double; 0 outside 0..n."""
    body = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(body)


def poly_to_binom(a: Column) -> Column:
    """Coefficients in the basis p^i (1-p)^(d-i), d being the degree of ``a``."""
    d = F.size(a) - F.lit(1)

    def term(i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda acc, j: acc + F.get(a, j) * choose(d - j, i - j))

    return F.transform(F.sequence(F.lit(0), d), term)


def binom_eval(b: Column, p: Column) -> Column:
    d = F.size(b) - F.lit(1)
    terms = F.transform(b, lambda c, i: c * F.pow(p, i) * F.pow(1 - p, d - i))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def array_apply(a: Column, b: Column, op: str) -> Column:
    """Elementwise ``+ - * /`` of two arrays over p; a missing entry gives null."""
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}
    return F.zip_with(a, b, ops[op])


# --- partitions: sorted arrays of bit masks, blocks of one member left out --------


def blocks_merge(a: Column, b: Column) -> Column:
    """The finest partition that both refine: blocks are joined whenever they share a member."""
    zero = F.lit(0).cast("bigint")

    def take(acc: Column, m: Column) -> Column:
        joined = F.aggregate(F.filter(acc, lambda x: x.bitwiseAND(m) != zero), m, lambda z, x: z.bitwiseOR(x))
        return F.concat(F.filter(acc, lambda x: x.bitwiseAND(m) == zero), F.array(joined))

    return F.array_sort(F.aggregate(b, a, take))


def blocks_project(a: Column, mask: Column) -> Column:
    """Blocks cut down to the members in ``mask``; blocks of fewer than two members vanish."""
    cut = F.transform(a, lambda x: x.bitwiseAND(mask))
    return F.array_sort(F.filter(cut, lambda x: F.bit_count(x) > 1))
