"""Payloads of a text recognition service to invoice lines, with what cannot be used kept and named instead of lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "quantity", "unit", "unit_price", "total")
_ITEMS = "array<struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>"


def _number(text: Column) -> Column:
    """A number with either decimal sign; null where it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def lines(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The other columns with item (from 0), name, quantity, unit, unit_price, total and rejected: torn (no JSON, or torn off), empty (no items), unnamed, or null.

    A payload is an item or a list of items. Numbers may be texts; what is no number is null. Quantity defaults to 1, the unit to un, and a missing
    total is quantity times price; nothing else is made up. A payload without usable items leaves one row, so nothing vanishes.
    """
    kept = [c for c in payloads.columns if c != column]
    parsed = payloads.withColumn("_items", F.from_json(column, _ITEMS))
    # a torn list leaves its whole items in place of null: the text must end as it began
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    whole = (F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))) | (F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")))
    torn = ~whole | F.col("_items").isNull()
    rows = parsed.withColumn("_torn", torn).select(*kept, "_torn", F.posexplode_outer(F.when(~F.col("_torn"), F.col("_items"))).alias("item", "_i"))
    name, quantity, price = F.trim(F.col("_i.name")), F.coalesce(_number(F.col("_i.quantity")), F.lit(1.0)), _number(F.col("_i.unit_price"))
    why = F.when(F.col("_torn"), "torn").when(F.col("_i").isNull(), "empty").when(F.coalesce(name, F.lit("")) == "", "unnamed")
    usable = lambda c: F.when(why.isNull(), c)
    unit = F.coalesce(F.nullif(F.trim(F.col("_i.unit")), F.lit("")), F.lit("un"))
    return rows.select(
        *kept, F.coalesce("item", F.lit(0)).alias("item"), usable(name).alias("name"), usable(quantity).alias("quantity"), usable(unit).alias("unit"), usable(price).alias("unit_price"),
        usable(F.coalesce(_number(F.col("_i.total")), quantity * price)).alias("total"), why.alias("rejected"),
    )
