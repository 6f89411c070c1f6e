"""Numbers as Column expressions: significant digits, medians, evidence, shares and rates.

All stay in the JVM. Arrays hold a run's few values (at most ten baseline runs), so sorting them in place is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_sig(value: Column, digits: int) -> Column:
    """A double to so many significant digits, half away from zero; 0 and non-finite values as they are."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(value))).cast("int")
    scale = F.pow(F.lit(10.0), F.abs(places).cast("double"))
    rounded = F.when(places >= 0, F.round(value * scale, 0) / scale).otherwise(F.round(value / scale, 0) * scale)
    return F.when((value == 0) | F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(rounded)


def round_sig_long(value: Column, digits: int) -> Column:
    """A non-negative long to so many significant digits, half up."""
    places = F.length(value.cast("string"))
    scale = F.pow(F.lit(10.0), (places - digits).cast("double")).cast("long")
    return F.when(places <= digits, value).otherwise(F.floor((value + F.floor(scale / 2)) / scale).cast("long") * scale)


def median_of(values: Column) -> Column:
    """The middle of an array<double>, the mean of the two middle ones for an even size; null when empty."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, F.greatest(low, F.lit(1))) + F.element_at(s, F.greatest(high, F.lit(1)))) / 2.0)


def mad_of(values: Column) -> Column:
    """The median absolute deviation from the median; null when empty."""
    middle = median_of(values)
    return median_of(F.transform(values, lambda v: F.abs(v - middle)))


def evidence(n: Column) -> Column:
    """How sure n quiet runs make one: (n + 1) / (n + 2)."""
    return (n.cast("double") + 1.0) / (n.cast("double") + 2.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole to two digits; null for an empty whole."""
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double"), 2))


def rate(part: Column, whole: Column) -> Column:
    """part / whole to as many significant digits as the denominator backs: 1 below 10, 2 below 100, else 3."""
    exact = part.cast("double") / whole.cast("double")
    return F.when(whole <= 0, F.lit(None)).when(whole < 10, round_sig(exact, 1)).when(whole < 100, round_sig(exact, 2)).otherwise(round_sig(exact, 3))
