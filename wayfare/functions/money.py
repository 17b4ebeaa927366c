"""Money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.constants import BASE_PRICE, MONEY, PRICE_PER_MILE


def money(value: Column) -> Column:
    return value.cast(MONEY)


def ticket_price(miles: Column) -> Column:
    """Fare before the cabin fee, to the cent.

    The inner rounding drops the last bits of the double, so that half cents round as they do
    when a float is first turned into a 15-digit number.
    """
    return money(F.round(miles * F.lit(PRICE_PER_MILE) + F.lit(float(BASE_PRICE)), 12))
