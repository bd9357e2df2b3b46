"""Numbers: IEEE division, resource quantities, units, texts of sample values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = float("nan"), float("inf")


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as floating point has it: by zero gives an infinity of the operands' signs, or NaN."""
    negative_zero = b.cast("string") == "-0.0"
    return (
        F.when(F.isnan(a) | F.isnan(b), F.lit(_NAN))
        .when(b != 0, F.try_divide(a, b))
        .when(a == 0, F.lit(_NAN))
        .when((a > 0) != negative_zero, F.lit(_INF))
        .otherwise(F.lit(-_INF))
    )


def divided(a: float, b: float) -> float:
    """The same of two numbers."""
    if math.isnan(a) or math.isnan(b) or (b == 0 and a == 0):
        return _NAN
    if b == 0:
        return math.copysign(_INF, a) * math.copysign(1, b)
    return a / b


# fixed values: suffixes of resource quantities and their factors
SUFFIXES = {
    "": 1.0,
    "m": 1e-3,
    "k": 1e3,
    "M": 1e6,
    "G": 1e9,
    "T": 1e12,
    "P": 1e15,
    "E": 1e18,
    "Ki": 1024.0,
    "Mi": 1024.0**2,
    "Gi": 1024.0**3,
    "Ti": 1024.0**4,
    "Pi": 1024.0**5,
    "Ei": 1024.0**6,
}


def quantity(text: Column) -> Column:
    """A resource quantity's number: digits, then a suffix or a power of ten; else null."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"^([0-9.+-]*)(.*)$", 1)
    suffix = F.regexp_extract(trimmed, r"^([0-9.+-]*)(.*)$", 2)
    plain = F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("double"))
    factor = F.lit(None).cast("double")
    for s, x in SUFFIXES.items():
        factor = F.when(suffix == s, F.lit(x)).otherwise(factor)
    power = F.when(suffix.rlike(r"^[eE][+-]?[0-9]+$"), F.concat(number, suffix).try_cast("double"))
    return F.when(plain.isNotNull(), F.coalesce(plain * factor, power))


# fixed values: the unit of each resource that is not counted in integers
UNITS = {"cpu": "core", "memory": "byte", "ephemeral-storage": "byte", "storage": "byte"}


def unit_for(resource: Column) -> Column:
    unit = F.lit("integer")
    for name, u in UNITS.items():
        unit = F.when(resource == name, F.lit(u)).otherwise(unit)
    return unit


def value_text(v: float) -> str:
    """A sample value as text: whole numbers below 1e15 without a point, others in the
    shortest positional form that reads back the same."""
    import numpy as np

    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    if v == math.trunc(v) and abs(v) < 1e15:
        return str(int(v))
    return np.format_float_positional(v, unique=True, trim="-")


def time_of(text: str | None, default: int) -> int:
    """Seconds from a decimal text, cut to whole ones; the default where it is no number."""
    try:
        v = float(text)
        return default if "_" in text or text != text.strip() else 0 if math.isnan(v) else max(-(2**63), min(2**63 - 1, int(v)) if math.isfinite(v) else (2**63 - 1 if v > 0 else -(2**63)))
    except (TypeError, ValueError):
        return default
