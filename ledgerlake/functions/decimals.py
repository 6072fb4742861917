"""Exact decimals: where a value becomes approximate is always a single, last step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY = "decimal(18,6)"
ADJUSTED = "decimal(38,12)"
#: Whole numbers that split factors are made of; a product beyond them raises.
FACTOR = "decimal(18,0)"
#: One unit in the last place of an adjusted quantity.
ULP = "0.000000000001"


def qty_is_zero(quantity: Column, inexact: Column) -> Column:
    """Whether a position counts as closed: null, or within one ULP for each of its ``inexact`` rows."""
    bound = inexact.cast("decimal(18,0)") * F.lit(ULP).cast("decimal(13,12)")
    return quantity.isNull() | (F.abs(quantity) <= bound)


def whole_ratio(first: Column, second: Column) -> tuple[Column, Column]:
    """Two decimals of up to six places as whole numbers in the same ratio: both times the least power of ten that makes them whole."""
    places = lambda x: F.length(F.regexp_extract(x.cast(QUANTITY).cast("string"), r"\.(\d*?)0*$", 1))
    power = F.element_at(F.array(*(F.lit(10**i) for i in range(7))), F.greatest(places(first), places(second)) + 1)
    return tuple((x.cast(QUANTITY) * power).cast(FACTOR) for x in (first, second))


def exact_product(values: Column) -> Column:
    """The product of an array of whole decimals; 1 for an empty one; nulls count as 1. Overflow raises."""
    one = F.lit(1).cast(FACTOR)
    return F.aggregate(values, one, lambda a, x: (a * F.coalesce(x.cast(FACTOR), one)).cast(FACTOR))


def scaled(value: Column, numerator: Column, denominator: Column, kind: str = ADJUSTED) -> Column:
    """value * numerator / denominator, rounded once, half away from zero, to twelve places.

    All steps are of whole numbers: millionths of the value are multiplied, divided, and the remainder gives
    the six places more. A result beyond nine trillion raises.
    """
    top, bottom = numerator.cast(FACTOR), denominator.cast(FACTOR)
    million = F.lit(1_000_000).cast("decimal(7,0)")
    product = ((F.abs(value.cast(QUANTITY)) * million).cast(FACTOR) * top).cast("decimal(37,0)")
    rest = ((product % bottom).cast(FACTOR) * million).cast("decimal(25,0)")
    left = (rest % bottom).cast(FACTOR)
    below = F.call_function("div", rest, bottom) + F.when(left * 2 >= bottom, 1).otherwise(0)
    units = (F.call_function("div", product, bottom).cast("decimal(19,0)") * million + below).cast("decimal(26,0)")
    trillion = F.lit(10**12).cast("decimal(13,0)")
    parts = (units % trillion).cast("decimal(12,0)") * F.lit("0.000000000001").cast("decimal(12,12)")
    exact = F.call_function("div", units, trillion).cast("decimal(26,12)") + parts
    sign = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    return F.when(top == bottom, value.cast(QUANTITY).cast(ADJUSTED)).otherwise((exact * sign).cast(ADJUSTED)).cast(kind)


def stated(text: Column, kind: str = QUANTITY) -> Column:
    """A struct (value, scale) of a decimal as text: its number, and the places that its source wrote, trailing zeros too; null if it's none."""
    plain = F.trim(text)
    whole, places = F.regexp_replace(F.split_part(plain, F.lit("."), F.lit(1)), "^[+-]", ""), F.split_part(plain, F.lit("."), F.lit(2))
    digits = F.concat(whole, places)
    fits = (digits != "") & (F.translate(digits, "0123456789", "") == "") & (F.length(plain) - F.length(F.replace(plain, F.lit("."), F.lit(""))) <= 1)
    return F.when(fits, F.struct(plain.try_cast(kind).alias("value"), F.length(places).alias("scale")))


def half_unit(scale: Column, floor: int = 2, most: int = 9) -> Column:
    """Half of one unit in the last of ``scale`` places, with at least ``floor`` places and at most ``most``."""
    halves = F.array(*(F.lit(f"{5 * 10 ** -(n + 1):.10f}").cast("decimal(11,10)") for n in range(floor, most + 1)))
    return F.element_at(halves, F.least(F.greatest(F.coalesce(scale, F.lit(floor)), F.lit(floor)), F.lit(most)) - floor + 1)


def shown(value: Column) -> Column:
    """A decimal as a double of six places, for results."""
    return value.cast("decimal(18,6)").cast("double")
