"""Rounding as published figures have it: half to even on a number's exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: splits a double into two halves of 26 bits, whose products are exact.
SPLIT = 134217729.0


def published(x: Column, digits: int) -> Column:
    """``x`` at so many digits, half to even, of what the double is and not of how it is printed: 2.675 is less than it looks.

    x times the power of ten is taken exactly, as a double and what it lacks; the nearest
    whole number is told from both. Numbers without digits to lose, and nulls, stay.
    """
    power = 10.0**digits
    split = lambda v: (SPLIT * v - (SPLIT * v - v), v - (SPLIT * v - (SPLIT * v - v)))
    tall, low = split(power)
    high, rest = split(x)
    product = x * power
    lacking = ((high * tall - product) + high * low + rest * tall) + rest * low
    below = F.floor(product)
    over = product - below
    up = (over > 0.5) | ((over == 0.5) & ((lacking > 0) | ((lacking == 0) & (below % 2 != 0))))
    # A product that is whole may stand for a number just below it, which rounds to it all the same.
    return F.when(F.abs(product) < 2.0**52, (below + F.when(up, 1).otherwise(0)) / power).otherwise(x)


def published_sql(x: str, digits: int) -> str:
    """The same for DuckDB, of a column or a simple expression of doubles."""
    power = f"1e{digits}"
    split = lambda v: (f"({SPLIT!r}::DOUBLE * {v} - ({SPLIT!r}::DOUBLE * {v} - {v}))", f"({v} - ({SPLIT!r}::DOUBLE * {v} - ({SPLIT!r}::DOUBLE * {v} - {v})))")
    (tall, low), (high, rest) = split(power), split(f"({x})")
    product = f"(({x}) * {power})"
    lacking = f"((({high} * {tall} - {product}) + {high} * {low} + {rest} * {tall}) + {rest} * {low})"
    below, over = f"floor({product})", f"({product} - floor({product}))"
    up = f"({over} > 5e-1 OR ({over} = 5e-1 AND ({lacking} > 0 OR ({lacking} = 0 AND {below} % 2 <> 0))))"
    return f"CASE WHEN abs({product}) < 4503599627370496e0 THEN ({below} + CASE WHEN {up} THEN 1 ELSE 0 END) / {power} ELSE ({x}) END"
