"""Vector expressions over ``array<float|double>`` columns, built from higher-order functions.

Sums run in element order in double precision, so a row's value does not depend on the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column, zero: str = "error") -> Column:
    """Divide by the norm. A zero or non-finite norm is an error, or with ``zero="keep"`` leaves a
    zero vector as it is."""
    n = norm(a)
    bad = F.isnan(n) | (n == float("inf"))
    if zero == "keep":
        divisor = F.when(n == 0, F.lit(1.0)).otherwise(n)
    else:
        divisor = F.when((n == 0) | bad, F.raise_error(F.lit("a vector of zero or non-finite norm")).cast("double")).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / divisor)


def parse_vector(raw: Column, dim: int | None = None) -> Column:
    """A list literal as doubles: blank is null; another dimension, a non-number or a non-finite
    number is an error."""
    v = F.from_json(F.trim(raw), "array<double>")
    wrong = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dim is not None:
        wrong = wrong | (F.size(v) != dim)
    blank = raw.isNull() | (F.trim(raw) == "")
    return F.when(blank, F.lit(None).cast("array<double>")).when(wrong, F.raise_error(F.concat(F.lit("not a vector: "), F.substring(raw, 1, 80))).cast("array<double>")).otherwise(v)


def parse_list(raw: Column) -> Column:
    """A list literal of strings, in single or double quotes; blank is an empty list."""
    v = F.from_json(F.trim(raw), "array<string>", {"allowSingleQuotes": "true"})
    blank = raw.isNull() | (F.trim(raw) == "")
    return F.when(blank, F.array().cast("array<string>")).when(v.isNull(), F.raise_error(F.concat(F.lit("not a list: "), F.substring(raw, 1, 80))).cast("array<string>")).otherwise(v)


def plane(bit: int, dim: int) -> list[float]:
    """A deterministic hyperplane: coordinates from a multiplicative hash, so that SQL can derive them."""
    return [((bit * dim + j + 1) * 2654435761 % 1000) / 500.0 - 1.0 for j in range(dim)]


def lsh_bucket(a: Column, planes: list[list[float]], order: str = "msb") -> Column:
    """The bucket of a vector: a bit per plane, set where the inner product is not negative.

    The first plane gives the highest bit (``msb``) or the lowest (``lsb``).
    """
    bits = [F.when(dot(a, F.array(*[F.lit(x) for x in p])) >= 0, F.lit(1)).otherwise(F.lit(0)) for p in planes]
    total = F.lit(0)
    for k, b in enumerate(bits):
        total = total + b * (1 << (len(bits) - 1 - k if order == "msb" else k))
    return total.cast("int")


def subvector(a: Column, part: int, width: int) -> Column:
    return F.slice(a, part * width + 1, width)


def pq_distance(code: Column, lut: Column) -> Column:
    """Sum of the query's table entries ``lut[part][code[part]]``."""
    return F.aggregate(F.zip_with(code, lut, lambda c, row: F.element_at(row, c + 1)), F.lit(0.0), lambda s, v: s + v)
