"""Price arithmetic on doubles, rounding halves toward plus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDERCUT, MARGIN, BAND = 0.95, 1.1, 0.03


def round2(x: Column) -> Column:
    return F.floor(x.cast("double") * 100 + 0.5).cast("double") / 100


def cents(x: Column) -> Column:
    return F.floor(x.cast("double") * 100 + 0.5).cast("long")


def undercut_factor(percent: Column) -> Column:
    """1 - u/100 for 0 <= u < 100, else the default; a null percent counts as 0."""
    u = F.coalesce(percent.cast("double"), F.lit(0.0))
    return F.when((u >= 0) & (u < 100), 1 - u / 100).otherwise(F.lit(UNDERCUT))


def margin_factor(percent: Column) -> Column:
    """1 / (1 - m/100) for 0 <= m < 100, else the default; a null percent counts as 0."""
    m = F.coalesce(percent.cast("double"), F.lit(0.0))
    return F.when((m >= 0) & (m < 100), 1 / (1 - m / 100)).otherwise(F.lit(MARGIN))


def floor_price(cost: Column, margin: Column | float = MARGIN) -> Column:
    return F.when(cost > 0, round2(cost * margin)).otherwise(F.lit(0.0))


def recommended(average: Column, cost: Column, undercut: Column | float = UNDERCUT, margin: Column | float = MARGIN) -> Column:
    """The undercut average, but not below the margin floor; null without an average."""
    return F.when(average > 0, F.greatest(round2(average * undercut), floor_price(cost, margin)))


def position(price: Column, average: Column) -> Column:
    """LEADING, COMPETITIVE (within the band) or OVERPRICED; INSUFFICIENT_DATA without an average."""
    gap, width = cents(price) - cents(average), F.floor(cents(average) * BAND + 0.5)
    return (
        F.when(average.isNull() | (average <= 0), "INSUFFICIENT_DATA")
        .when(F.abs(gap) <= width, "COMPETITIVE").when(gap < 0, "LEADING").otherwise("OVERPRICED")
    )


def change_kind(previous: Column, new: Column, was: Column, now: Column) -> Column:
    """Availability first, then the price; null if nothing changed or there is no earlier price."""
    return (
        F.when((was != "out_of_stock") & (now == "out_of_stock"), "out_of_stock")
        .when((was == "out_of_stock") & (now == "in_stock"), "back_in_stock")
        .when(previous.isNotNull() & new.isNotNull() & (new < previous), "price_decrease")
        .when(previous.isNotNull() & new.isNotNull() & (new > previous), "price_increase")
    )


def change_percent(previous: Column, new: Column) -> Column:
    return F.when(previous == 0, 0.0).otherwise((new - previous) / previous * 100)
