"""Money is DECIMAL from the scan to the last projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(12,2)"
# What an amount sent as text may be; the application has no bound of its own.
TEXT_AMOUNT = "decimal(38,2)"
# Holds any price times any quantity.
WIDE_AMOUNT = "decimal(29,2)"


def leading_int(value: Column) -> Column:
    """Integer at the start of the text, 0 where there is none."""
    digits = F.regexp_extract(value.cast("string"), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_amount(value: Column, kind: str = TEXT_AMOUNT) -> Column:
    """Decimal number at the start of the text, 0 where there is none."""
    number = F.regexp_extract(value.cast("string"), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.coalesce(number.try_cast(kind), F.lit(0).cast(kind))


def money_text(value: Column) -> Column:
    """Two decimals, ``0.00`` where the value is not a number."""
    return leading_amount(value).cast("string")


def line_subtotal(subtotal: Column, quantity: Column, unit_price: Column) -> Column:
    """The stored subtotal; quantity times price where it is missing or 0."""
    computed = (unit_price * quantity).cast(WIDE_AMOUNT)
    return F.when(F.coalesce(subtotal, F.lit(0)) != 0, subtotal.cast(WIDE_AMOUNT)).otherwise(computed)
