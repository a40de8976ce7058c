"""Column expressions shared by operators: digests, units, bins, polynomials, matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def text_of(c: Column) -> Column:
    """Text of an identity input; an absent one counts as empty, so that positions cannot shift."""
    return F.coalesce(c.cast("string"), F.lit(""))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def to_si(value: Column, factor: Column) -> Column:
    """A quantity in SI units; without a factor it has none."""
    return value * factor


def list_to_si(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda v: v * factor)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines in C do: scaled, halves away from zero, scaled back; the sign of zero stays.

    Spark's own ``round`` goes by the decimal text, which decides some halves otherwise and has no negative zero.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.rint(scaled)
    whole = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole)
    back = whole / F.lit(10.0**digits)
    return F.when(F.abs(back) == float("inf"), x).otherwise(back)


def uniform_bin(value: Column, start: float, width: float) -> Column:
    return F.floor((value - F.lit(start)) / F.lit(width))


def edge_bin(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [lo, hi) that holds a value; -1 below all edges, len(edges) - 1 from the last on."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value)) - 1


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """c0 + c1 x + c2 x^2 + ... by Horner's rule."""
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def affine(matrix: list[list[float]], point: list[Column]) -> list[Column]:
    """A 4x4 (or 3x4) matrix applied to a point in homogeneous coordinates."""
    return [reduce(lambda a, b: a + b, [F.lit(row[k]) * point[k] for k in range(3)]) + F.lit(row[3]) for row in matrix[:3]]


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)]))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def size_class(n_bytes: Column) -> Column:
    """Attachment classes: below 1 MB, up to 10 MB, above."""
    return F.when(n_bytes < 1_000_000, "embed").when(n_bytes <= 10_000_000, "embed_or_link").otherwise("link")
