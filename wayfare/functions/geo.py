"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.constants import DEGREES_PER_RADIAN, EARTH_RADIUS_MILES


def radians(degrees: Column) -> Column:
    return degrees / F.lit(DEGREES_PER_RADIAN)


def arc_miles(cosine: Column, mode: str = "reference") -> Column:
    """Miles along the arc whose central angle has the given cosine.

    ``reference`` keeps the arc-tangent form: 0 at a right angle and negative beyond it.
    ``exact`` uses the arc cosine. Both tolerate a cosine that rounding pushed past 1.
    """
    if mode == "exact":
        bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
        return F.lit(EARTH_RADIUS_MILES) * F.acos(bounded)
    if mode != "reference":
        raise ValueError(f"unknown distance mode {mode!r}")
    sine = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - cosine * cosine))
    return F.when(cosine != 0, F.lit(EARTH_RADIUS_MILES) * F.atan(sine / cosine)).when(
        cosine == 0, F.lit(0.0)
    )


def great_circle_miles(
    lat1: Column, long1: Column, lat2: Column, long2: Column, mode: str = "reference"
) -> Column:
    cosine = F.sin(radians(lat1)) * F.sin(radians(lat2)) + F.cos(radians(lat1)) * F.cos(
        radians(lat2)
    ) * F.cos(radians(long2) - radians(long1))
    return arc_miles(cosine, mode)


def airport_trig(airports: DataFrame, prefix: str) -> DataFrame:
    """One row per airport with its sines and cosines worked out once, not once per flight."""
    return airports.selectExpr(
        f"iata as {prefix}_iata",
        f"sin(lat / {DEGREES_PER_RADIAN}D) as {prefix}_sin",
        f"cos(lat / {DEGREES_PER_RADIAN}D) as {prefix}_cos",
        f"long / {DEGREES_PER_RADIAN}D as {prefix}_long",
    )


def trig_miles(start: str, end: str, mode: str = "reference") -> Column:
    """Distance between two airports joined in from :func:`airport_trig`."""
    cosine = F.expr(
        f"{start}_sin * {end}_sin + {start}_cos * {end}_cos * cos({end}_long - {start}_long)"
    )
    return arc_miles(cosine, mode)
