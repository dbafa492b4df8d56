"""What a recipe's line costs when its unit is not the one the ingredient is priced in: a path of conversions, tried in order.

From the line's unit to the priced one lead: nothing (pieces of pieces), the factors of one family, the content of a piece in millilitres or grams, and the density between
grams and millilitres. The first path that has all its numbers counts; its name comes with the cost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.units import base_quantity, base_unit, repaired_quantity


def line_cost(quantity: Column, unit: Column, unit_cost: Column, priced_in: Column, piece_grams: Column, piece_ml: Column, density: Column) -> Column:
    """Struct of path, converted (in priced_in) and cost. priced_in is g, ml or un, unit_cost the price of one; density in g a ml. Path is null where none leads there, `unpriced` without a price."""
    own = base_unit(unit)
    amount = base_quantity(repaired_quantity(quantity, unit), unit)
    solid = lambda x: F.coalesce(x > 0, F.lit(False))
    steps = [
        ("unitless", F.coalesce(F.trim(unit), F.lit("")) == "", quantity),
        ("pieces", (own == "un") & (priced_in == "un"), amount),
        ("same_family", own == priced_in, amount),
        ("piece_volume", (own == "ml") & (priced_in == "un") & solid(piece_ml), amount / piece_ml),
        ("piece_weight", (own == "g") & (priced_in == "un") & solid(piece_grams), amount / piece_grams),
        ("pieces_by_weight", (own == "un") & (priced_in == "g") & solid(piece_grams), amount * piece_grams),
        ("pieces_by_volume", (own == "un") & (priced_in == "ml") & solid(piece_ml), amount * piece_ml),
        ("density", (own == "ml") & (priced_in == "g") & solid(density), amount * density),
        ("density", (own == "g") & (priced_in == "ml") & solid(density), amount / density),
    ]
    none = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("converted"), F.lit(None).cast("double").alias("cost"))
    out = none
    for path, holds, converted in reversed(steps):
        out = F.when(holds, F.struct(F.lit(path).alias("path"), converted.alias("converted"), (converted * unit_cost).alias("cost"))).otherwise(out)
    return F.when(solid(unit_cost), out).otherwise(F.struct(F.lit("unpriced").alias("path"), F.lit(None).cast("double").alias("converted"), F.lit(None).cast("double").alias("cost")))
