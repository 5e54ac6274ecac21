"""Column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from peerwatch import labels

# Moduli and multipliers of the row hash; products stay below 2**63.
PRIME31 = 2147483647
PRIME32 = 4294967291
MULTIPLIERS = (433494437, 715827883, 1431655777)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rate(numerator, denominator) -> Column:
    """Share with the denominator floored at one."""
    return col(numerator) / F.greatest(col(denominator), F.lit(1))


def log_volume(c) -> Column:
    return F.log1p(col(c))


def percent(part, whole, digits: int | None = 2) -> Column:
    """100 * part / whole, NULL when whole is zero; rounds half to even."""
    value = F.try_divide(col(part).cast("double"), col(whole).cast("double")) * 100
    return value if digits is None else F.bround(value, digits)


def month_index(c) -> Column:
    return F.year(col(c)) * 12 + F.month(col(c))


def month_label(c) -> Column:
    return F.date_format(col(c), "MM/yyyy")


def direction(c) -> Column:
    value = col(c)
    return (
        F.when(value > 0, F.lit(labels.ABOVE))
        .when(value < 0, F.lit(labels.BELOW))
        .otherwise(F.lit(labels.AT_CENTRE))
    )


def persistence_band(c) -> Column:
    value = col(c)
    rules = [(name, low) for name, low in labels.BANDS if low is not None]
    first, *rest = rules
    out = F.when(value >= first[1], F.lit(first[0]))
    for name, low in rest:
        out = out.when(value >= low, F.lit(name))
    return out.when(value.isNotNull(), F.lit(labels.BANDS[-1][0]))


def lookup(c, mapping: dict) -> Column:
    """Value of a small literal mapping, NULL for unknown keys."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, col(c))


def band(c, cuts: list[float]) -> Column:
    """0-based interval of a value among ascending cut points (value <= cut stays below)."""
    value = col(c)
    return reduce(lambda acc, cut: acc + (value > F.lit(cut)).cast("int"), cuts, F.lit(0))


def fold32(*parts) -> Column:
    """Hash of integer parts, uniform below PRIME32.

    The same value on any partitioning and in plain SQL: multiplications under
    alternating prime moduli, then two rounds of shift and xor.  Steps that use
    their input twice come only at the end, which keeps the expression short.
    """
    a, b, c = MULTIPLIERS
    acc = F.lit(0).cast("bigint")
    for part in parts:
        value = (part if isinstance(part, Column) else F.lit(part)).cast("bigint")
        acc = ((acc + F.pmod(value, F.lit(PRIME31))) * F.lit(a) + F.lit(12345)) % F.lit(PRIME32)
        acc = (acc * F.lit(b) + F.lit(1)) % F.lit(PRIME31)
    acc = (acc.bitwiseXOR(F.shiftright(acc, 15)) * F.lit(c)) % F.lit(PRIME32)
    acc = (acc.bitwiseXOR(F.shiftright(acc, 13)) * F.lit(b)) % F.lit(PRIME32)
    return acc


def fold32_int(*parts: int) -> int:
    """The same hash of plain integers, for use inside a task."""
    a, b, c = MULTIPLIERS
    acc = 0
    for part in parts:
        acc = ((acc + part % PRIME31) * a + 12345) % PRIME32
        acc = (acc * b + 1) % PRIME31
    acc = ((acc ^ (acc >> 15)) * c) % PRIME32
    return ((acc ^ (acc >> 13)) * b) % PRIME32


def fold32_array(first: np.ndarray, *parts: int) -> np.ndarray:
    """The same hash of an array of integers and further plain ones."""
    a, b, c = MULTIPLIERS
    acc = np.zeros(len(first), np.int64)
    for part in (first.astype(np.int64), *parts):
        acc = ((acc + part % PRIME31) * a + 12345) % PRIME32
        acc = (acc * b + 1) % PRIME31
    acc = ((acc ^ (acc >> 15)) * c) % PRIME32
    return ((acc ^ (acc >> 13)) * b) % PRIME32


def uniform_array(hashed: np.ndarray) -> np.ndarray:
    return (hashed.astype(float) + 0.5) / float(PRIME32)


def uniform(hashed):
    """Open interval (0, 1) from a hash, column or number."""
    wide = hashed.cast("double") if isinstance(hashed, Column) else float(hashed)
    return (wide + 0.5) / float(PRIME32)
