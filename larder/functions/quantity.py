"""Quantity and unit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import rules
from larder.functions.common import blank_to_null, bound, col_of, lookup, words_regex

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_FRACTION = r"^(\d+)\s*/\s*(\d+)$"
_MIXED = r"^(\d+)[\s\-]+(\d+)\s*/\s*(\d+)$"


def parse_quantity(c: Column | str) -> Column:
    """``struct(quantity DOUBLE, status STRING)`` of a written quantity.

    The pattern is tested before each cast, because Spark reads ``1d`` as a number
    and ANSI mode raises on text that is not one.
    """
    return bound(blank_to_null(c), _parse)


def _parse(text: Column) -> Column:
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("double")

    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    fraction = F.try_divide(part(_FRACTION, 1), part(_FRACTION, 2))
    mixed = part(_MIXED, 1) + F.try_divide(part(_MIXED, 2), part(_MIXED, 3))
    known = lookup(text, rules.RUN_TOGETHER_FRACTIONS)
    value = (
        F.when(known.isNotNull(), known)
        .when(number >= 0, number)
        .when(text.rlike(_FRACTION), fraction)
        .when(text.rlike(_MIXED), mixed)
    )
    status = (
        F.when(text.isNull(), "MISSING_QUANTITY")
        .when(known.isNotNull(), "PARSED_ANOMALY")
        .when(value.isNull(), "PARSE_ERROR")
        .when(number.isNotNull(), "PARSED_NUMERIC")
        .when(text.rlike(_FRACTION), "PARSED_FRACTION")
        .otherwise("PARSED_MIXED_FRACTION")
    )
    return F.struct(value.alias("quantity"), status.alias("status"))


def normalize_unit(c: Column | str) -> Column:
    """Unit key; unknown units are kept, blank ones become NULL."""
    return bound(F.lower(blank_to_null(c)), lambda unit: F.coalesce(lookup(unit, rules.UNIT_SPELLINGS), unit))


def water_grams(quantity: Column, unit: Column) -> Column:
    return quantity * lookup(unit, rules.WATER_GRAMS)


_LEAD_MIXED = r"^(\d+)\s*-\s*(\d+)\s*/\s*(\d+)"
_LEAD_FRACTION = r"^(\d+)\s*/\s*(\d+)"
_LEAD_NUMBER = r"^(\d+(?:\.\d+)?)"


def leading_quantity(c: Column | str) -> Column:
    """``struct(quantity, rest)``: the written amount in front of a line."""
    text = F.trim(col_of(c))

    def take(pattern: str, *pieces: Column) -> Column:
        return F.struct(
            F.concat(*pieces).alias("quantity"),
            F.trim(F.regexp_replace(text, pattern, "")).alias("rest"),
        )

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    return (
        F.when(
            text.rlike(_LEAD_MIXED),
            take(_LEAD_MIXED, group(_LEAD_MIXED, 1), F.lit(" "), group(_LEAD_MIXED, 2), F.lit("/"), group(_LEAD_MIXED, 3)),
        )
        .when(
            text.rlike(_LEAD_FRACTION),
            take(_LEAD_FRACTION, group(_LEAD_FRACTION, 1), F.lit("/"), group(_LEAD_FRACTION, 2)),
        )
        .when(text.rlike(_LEAD_NUMBER), take(_LEAD_NUMBER, group(_LEAD_NUMBER, 1)))
        .otherwise(F.struct(F.lit("").alias("quantity"), text.alias("rest")))
    )


LEADING_UNIT = "(?i)^" + words_regex(rules.LINE_UNITS, boundary=False) + r"\b"


def leading_unit(c: Column | str) -> Column:
    """``struct(unit, rest)``: the unit word in front of a line."""
    text = col_of(c)
    return F.struct(
        F.lower(F.regexp_extract(text, LEADING_UNIT, 0)).alias("unit"),
        F.when(text.rlike(LEADING_UNIT), F.trim(F.regexp_replace(text, LEADING_UNIT, ""))).otherwise(text).alias("rest"),
    )
