"""Column expressions over numbers: percentages, rounding, formats, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up


def percent(mode: str, a: Column, b: Column) -> Column:
    """of, is-what, change, add, subtract, total; null where the divisor is 0."""
    if mode == "of":
        return b * a / 100
    if mode == "is-what":
        return a / F.nullif(b, F.lit(0.0)) * 100
    if mode == "change":
        return (b - a) / F.nullif(F.abs(a), F.lit(0.0)) * 100
    if mode == "add":
        return b * (1 + a / 100)
    if mode == "subtract":
        return b * (1 - a / 100)
    if mode == "total":
        return a / F.nullif(b, F.lit(0.0)) * 100
    raise ValueError(mode)


def percentage_points(a: Column, b: Column) -> dict[str, Column]:
    """points and relative change; NaN where the first is 0."""
    return {"points": b - a, "relative": F.when(a == 0, float("nan")).otherwise((b - a) / F.nullif(F.abs(a), F.lit(0.0)) * 100)}


# How many of a unit make the next one, and its name.
TIMES = ((60, "minutes"), (60, "hours"), (24, "days"), (365, "years"), (1000, "thousand years"), (1000, "million years"))


def crack_time(bits: Column) -> Column:
    """How long 10^12 guesses a second take for half of 2^bits."""
    seconds = F.pow(F.lit(2.0), bits - 1) / 1e12
    size, steps = 1.0, [(seconds, F.lit("seconds"))]
    for n, name in TIMES:
        size *= n
        steps.append((seconds / size, F.lit(name)))
    value, unit = steps[0]
    size = 1.0
    for (n, _), (v, u) in zip(TIMES, steps[1:], strict=True):  # the largest unit of which there is one at least
        size *= n
        value, unit = F.when(seconds >= size, v).otherwise(value), F.when(seconds >= size, u).otherwise(unit)
    shown = F.when(value < 10, F.format_string("%.1f", half_up(value, 1))).otherwise(F.format_number(half_up(value), 0))
    return F.when(seconds < 1, "instantly").when(value > 1000, "longer than the age of the universe").otherwise(F.concat_ws(" ", shown, unit))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def band(c: Column, floor: float, target: float) -> Column:
    """Linear credit: 0 at floor, 1 at target."""
    return clamp01((c - floor) / (target - floor))


def byte_format(c: Column) -> Column:
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024**2, F.format_string("%.1f KB", half_up(c / 1024, 1)))
        .when(c < 1024**3, F.format_string("%.2f MB", half_up(c / 1024**2, 2)))
        .otherwise(F.format_string("%.2f GB", half_up(c / 1024**3, 2)))
    )


def number_format(c: Column) -> Column:
    """At most four decimals, grouped by commas, no trailing zeros."""
    text = F.format_number(c, 4)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "—").otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def entropy_bits(text: Column) -> Column:
    """Length times log2 of the pool of the classes that occur, to one place."""
    pool = sum((F.when(text.rlike(p), n).otherwise(0) for p, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^a-zA-Z0-9]", 25))), F.lit(0))
    return F.when(pool > 0, half_up(F.length(text) * F.log2(pool.cast("double")), 1)).otherwise(0.0)
