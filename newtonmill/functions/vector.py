"""Vectors as array<double> columns: element-wise operations, products and norms in built-in higher-order functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import uniform


def constant(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def random_fill(key: Column, n: int, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """n uniform numbers that depend on key and seed alone."""
    return F.array(*(F.lit(low) + F.lit(high - low) * uniform(key, F.lit(seed), F.lit(k)) for k in range(n)))


def indices(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def add(a: Column, b: Column, times: float = 1.0) -> Column:
    """a + times * b"""
    return F.zip_with(a, b, lambda x, y: x + F.lit(float(times)) * y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def scale(a: Column, c: Column | float) -> Column:
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.transform(a, lambda x: x * c)


def shifted(a: Column, c: float, k: float) -> Column:
    """(c - a) * k"""
    return F.transform(a, lambda x: (F.lit(float(c)) - x) * F.lit(float(k)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column, start: int = 1, length: int | None = None) -> Column:
    """Dot product, of a part if start (from 1) and length are given."""
    if length is not None:
        a, b = F.slice(a, start, length), F.slice(b, start, length)
    return total(multiply(a, b))


def norm_power(a: Column, p: float) -> Column:
    """The p-norm to the power of p."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(p))))


def norm(a: Column, p: float = 2) -> Column:
    """The p-norm; p may be infinite."""
    if p == float("inf"):
        return F.array_max(F.transform(a, F.abs))
    if p == 1:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    if p == 2:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.pow(norm_power(a, p), F.lit(1.0 / p))


def nonzeros(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x != 0))


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def zero_small(a: Column, eps: float) -> Column:
    """Items of magnitude up to and including eps become 0."""
    return F.transform(a, lambda x: F.when(F.abs(x) <= eps, 0.0).otherwise(x))


def clamp(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def clamp_each(a: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.zip_with(a, high, lambda x, h: F.least(x, h)), low, lambda x, m: F.greatest(x, m))


def sign(a: Column) -> Column:
    """1 for positive items, else -1: zero counts as negative here, unlike in scalar.sign."""
    return F.transform(a, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))


def each(a: Column, name: str) -> Column:
    """An element-wise function by name."""
    known = {
        "abs": F.abs, "exp": F.exp, "log": F.log, "sqrt": F.sqrt, "square": lambda x: x * x, "inverse": lambda x: 1 / x,
        "inverse_square": lambda x: 1 / (x * x), "negative": lambda x: -x, "sigmoid": sigmoid, "sigmoid_series": lambda x: sigmoid_series(x),
    }
    return F.transform(a, known[name])


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def sigmoid_series(x: Column, terms: int = 10) -> Column:
    """The sigmoid by as many terms of the exponential series of -|x|."""
    term = total_ = F.lit(1.0)
    for k in range(1, terms):
        term = term * F.abs(x) / float(k)
        total_ = total_ + term
    return F.when(x >= 0, total_ / (1 + total_)).otherwise(1 / (1 + total_))


def difference_norm(a: Column, b: Column) -> Column:
    return norm(add(a, b, -1.0))
