"""Number rules of the domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity; what lies below a millionth is rounding noise of the sum."""
    return F.floor(F.round(x, 6) + 0.5)


def exact_sum(x: Column) -> Column:
    """Sum in decimals of eight digits, rounded to four: the same whatever the order of the rows."""
    return F.round(F.sum(x.cast("decimal(28,8)")), 4).cast("double")


def exact_mean(x: Column) -> Column:
    return exact_sum(x) / F.nullif(F.count(x), F.lit(0))


def shown(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)


def pct_change(old: Column, new: Column) -> Column:
    """Change in percent; null where the old value is zero within EPSILON or either is missing."""
    return F.when(F.abs(old) > EPSILON, (new - old) / old * 100)


def gross_margin_pct(selling_price: Column, cost: Column) -> Column:
    return F.when(selling_price > 0, (selling_price - cost) / selling_price * 100)


def food_cost_pct(selling_price: Column, cost: Column) -> Column:
    return F.when(selling_price > 0, cost / selling_price * 100)


def unit_cost(price: Column, quantity: Column) -> Column:
    """Pack price per base unit; null unless both are positive."""
    return F.when((price > 0) & (quantity > 0), price / F.greatest(quantity, F.lit(1.0)))


def monthly_exposure(line_cost: Column, recipes: Column) -> Column:
    """Modelled monthly cost: 30 covers for each recipe, 120 without one."""
    covers = F.when(recipes > 0, recipes * 30).otherwise(120)
    return F.when(line_cost > 0, half_up(line_cost * covers)).otherwise(F.lit(0)).cast("long")


def impact_band(drop: Column) -> Column:
    return F.when(drop > 5, "HIGH").when(drop > 2, "MEDIUM").otherwise("LOW")


def margin_label(margin: Column) -> Column:
    return F.when(margin.isNull(), "unknown").when(margin >= 65, "healthy").when(margin >= 55, "watch").otherwise("critical")


def ratio(a: Column, b: Column) -> Column:
    """The larger over the smaller of two positive numbers; 1 where one is not positive."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b)).otherwise(1.0)
