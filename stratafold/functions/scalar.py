"""Scalar and row-wise expressions with the number rules of floating-point data frames.

NULL, NaN and infinities are three different things in Spark. ``present`` turns NaN into NULL, so
that "missing" means one thing in the operators built on it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

ColumnLike = Column | str
INF = float("inf")


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: ColumnLike) -> Column:
    """Widen to double, so that squares and products of integers cannot overflow."""
    return col(c).cast("double")


def present(c: ColumnLike) -> Column:
    """Double value with NaN as NULL."""
    x = num(c)
    return F.when(~F.isnan(x), x)


def is_missing(c: ColumnLike) -> Column:
    return col(c).isNull() | F.isnan(num(c))


def is_infinite(c: ColumnLike) -> Column:
    return F.coalesce(F.abs(num(c)) == F.lit(INF), F.lit(False))


def is_finite(c: ColumnLike) -> Column:
    """Neither NULL, NaN nor infinite. NaN sorts above every number, so one comparison covers both."""
    return F.coalesce(F.abs(num(c)) < F.lit(INF), F.lit(False))


def finite(c: ColumnLike) -> Column:
    return F.when(is_finite(c), num(c))


def divide(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b with the floating-point results for b = 0: signed infinity, or NaN for 0 / 0."""
    x, y = num(a), num(b)
    at_zero = F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF)).otherwise(F.lit(float("nan")))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(F.isnan(x), x).when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def floored_mod(c: ColumnLike, modulus: float) -> Column:
    """Modulo with the sign of the modulus (-10 mod 360 is 350)."""
    return F.pmod(num(c), F.lit(float(modulus)))


def square(c: ColumnLike) -> Column:
    x = num(c)
    return x * x


def total(cols: list[ColumnLike]) -> Column:
    return reduce(add, [num(c) for c in cols])


def clip(c: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL and NaN stay what they are."""
    x = num(c)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(out)


def log1p_clipped(c: ColumnLike) -> Column:
    """log(1 + max(0, x)); the clip keeps the argument inside the domain."""
    return F.log1p(clip(c, low=0.0))


def row_sum(cols: list[ColumnLike]) -> Column:
    return total(cols)


# The row statistics below skip missing values, as data-frame reductions along a row do.


def _row_count(cols: list[ColumnLike]) -> Column:
    return reduce(add, [F.when(is_missing(c), F.lit(0.0)).otherwise(F.lit(1.0)) for c in cols])


def row_mean(cols: list[ColumnLike]) -> Column:
    return F.try_divide(reduce(add, [F.coalesce(present(c), F.lit(0.0)) for c in cols]), _row_count(cols))


def row_max(cols: list[ColumnLike]) -> Column:
    return F.greatest(*[present(c) for c in cols]) if len(cols) > 1 else present(cols[0])


def row_min(cols: list[ColumnLike]) -> Column:
    return F.least(*[present(c) for c in cols]) if len(cols) > 1 else present(cols[0])


def row_range(cols: list[ColumnLike]) -> Column:
    return row_max(cols) - row_min(cols)


def row_std(cols: list[ColumnLike]) -> Column:
    """Sample standard deviation (n - 1) across the listed columns of one row; NULL below two values."""
    mean = row_mean(cols)
    squares = reduce(add, [F.coalesce(square(present(c) - mean), F.lit(0.0)) for c in cols])
    n = _row_count(cols)
    return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))


def cut(c: ColumnLike, edges: list[float], labels: list[str]) -> Column:
    """Right-open bins [edge, next edge) with labels; NULL outside the edges."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    x = num(c)
    out = F.when((x < F.lit(float(edges[0]))) | F.isnan(x), F.lit(None).cast("string"))
    for high, label in zip(edges[1:], labels):
        out = out.when(x < F.lit(float(high)), F.lit(label))
    return out


def dummies(c: ColumnLike, categories: list, prefix: str) -> list[Column]:
    """One 0/1 column per listed category; a value outside the list (or NULL) gives all zeros."""
    return [F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in categories]


# --- probability vectors ---------------------------------------------------------------------


def argmax(probs: ColumnLike) -> Column:
    """0-based index of the largest entry, the first one on ties."""
    p = col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def mix(probs: list[ColumnLike], weights: list[float] | None = None) -> Column:
    """Entry-wise mean (or weighted sum) of equally long probability arrays."""
    if weights is None:
        scale = F.lit(float(len(probs)))
        summed = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [col(p) for p in probs])
        return F.transform(summed, lambda x: x / scale)

    def times(p: ColumnLike, w: float) -> Column:
        return F.transform(col(p), lambda x: x * F.lit(float(w)))

    scaled = [times(p, w) for p, w in zip(probs, weights, strict=True)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)


def expand_slots(probs: ColumnLike, known: list, classes: list) -> Column:
    """Re-map an array over the ``known`` classes to slots for all ``classes``; 0 for the others."""
    p = col(probs)
    at = {c: i for i, c in enumerate(known)}
    return F.array(*[F.coalesce(p[at[c]].cast("double"), F.lit(0.0)) if c in at else F.lit(0.0) for c in classes])


def one_hot(pred: ColumnLike, classes: list) -> Column:
    return F.array(*[F.coalesce((col(pred) == F.lit(c)).cast("double"), F.lit(0.0)) for c in classes])


def decode(index: ColumnLike, classes: list) -> Column:
    """Class label for a 0-based class index; NULL outside the list."""
    return F.get(F.array(*[F.lit(c) for c in classes]), col(index).cast("int"))


# --- text ------------------------------------------------------------------------------------


# The characters that count as white space.
_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def first_line(c: ColumnLike, width: int = 60) -> Column:
    """First line of the stripped text, cut to ``width`` characters; NULL for blank text."""
    stripped = F.btrim(col(c), F.lit(_WHITE))
    line = F.element_at(F.split(stripped, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", 2), 1)
    return F.when(F.length(stripped) > 0, F.substring(line, 1, width))


def format_fixed(c: ColumnLike, digits: int) -> Column:
    """Fixed decimals, rounding the exact binary value (1.95 is a little below 1.95 and gives ``1.9``).

    Spark's own formatting rounds the shortest decimal text instead. The value is cut into two halves
    whose products with the power of ten are exact, so the side of the midpoint is never misjudged.
    """
    x, scale = F.abs(num(c)), float(10**digits)
    head = x * 134217729.0 - (x * 134217729.0 - x)  # upper half of the 53-bit significand
    below = F.floor(x * scale).cast("double")
    beyond = (head * scale - (below + 0.5)) + (x - head) * scale
    up = (beyond > 0) | ((beyond == 0) & (below % 2 == 1))
    exact = F.format_string(f"%.{digits}f", (below + F.when(up, 1.0).otherwise(0.0)) / scale)
    # from 2^53 on, the scaled value has no fraction and a bigint may not hold it; the number itself is exact
    whole = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit("." + "0" * digits))
    text = F.when(x * scale < 2.0**53, exact).otherwise(whole)
    signed = F.concat(F.when(num(c) < 0, "-").otherwise(""), F.when(x == float("inf"), "inf").otherwise(text))
    return F.when(F.isnan(num(c)), "nan").otherwise(signed)


def format_seconds(c: ColumnLike) -> Column:
    """``1.50h``, ``2.0m`` or ``3.2s``; ``-`` when missing."""
    s = num(c)
    return (
        F.when(s.isNull(), F.lit("-"))
        .when(s >= 3600, F.concat(format_fixed(s / 3600, 2), F.lit("h")))
        .when(s >= 60, F.concat(format_fixed(s / 60, 1), F.lit("m")))
        .otherwise(F.concat(format_fixed(s, 1), F.lit("s")))
    )


def format_score(c: ColumnLike) -> Column:
    return F.when(num(c).isNull(), F.lit("-")).otherwise(format_fixed(c, 5))
