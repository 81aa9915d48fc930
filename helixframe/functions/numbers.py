"""Arithmetic on doubles with the results of C and of SQL engines built on it, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor(x: Column) -> Column:
    """The floor as a double, so that a negative zero, huge numbers, infinities and nan keep their value."""
    return F.when((F.abs(x) < 2.0**52) & (x != 0), F.floor(x).cast("double")).otherwise(x)


def rounded(x: Column, digits: int) -> Column:
    """x rounded to so many decimals, halves away from zero, by the double x * 10 ** digits; F.round goes by the shortest
    text of x instead and loses the sign of a negative zero."""
    t = x * 10.0**digits
    low = floor(F.abs(t))
    size = low + F.when(F.abs(t) - low >= 0.5, 1.0).otherwise(0.0)
    whole = F.when(t > 0, size).when(t < 0, -size).otherwise(t)
    return F.when(F.abs(t) < math.inf, whole / 10.0**digits).otherwise(x)


def fixed(x: Column) -> Column:
    """C's %.3f of a number that is cut to three decimals, where doubles hold as many. Java's formatter has no digits
    beyond the shortest text of a double, so large numbers go by their exact digits (DuckDB's printf leaves these at
    some numbers from about 5.9e20 on)."""
    size = F.abs(x)
    exact = F.java_method(F.lit("scala.math.BigDecimal"), F.lit("exact"), x)
    some = F.when(size < 2.0**43, F.format_string("%.3f", x)).when(size < 2.0**52, F.bround(exact.cast("decimal(38,12)"), 3).cast("string"))
    known = some.when(size < math.inf, F.concat(exact, F.lit(".000"))).when(x == math.inf, F.lit("inf")).when(x == -math.inf, F.lit("-inf"))
    return known.when(F.isnan(x), F.lit("nan"))
