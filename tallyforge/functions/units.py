"""Units of quantity: families, base units and conversion costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings by base unit, with the factor to it. mg stands for g in pack texts, unscaled.
TO_BASE = {
    "kg": ("g", 1000.0), "g": ("g", 1.0), "gr": ("g", 1.0), "l": ("ml", 1000.0), "lt": ("ml", 1000.0), "cl": ("ml", 10.0),
    "dl": ("ml", 100.0), "ml": ("ml", 1.0), "un": ("un", 1.0), "unit": ("un", 1.0), "unidade": ("un", 1.0), "pcs": ("un", 1.0),
}
FAMILY = {"g": "weight", "ml": "volume", "un": "countable"}


def _lookup(unit: Column, values: dict) -> Column:
    out = F.lit(None)
    key = F.lower(F.trim(unit))
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def base_unit(unit: Column) -> Column:
    return _lookup(unit, {k: v[0] for k, v in TO_BASE.items()})


def base_factor(unit: Column) -> Column:
    return _lookup(unit, {k: v[1] for k, v in TO_BASE.items()})


def base_quantity(quantity: Column, unit: Column) -> Column:
    """Quantity in the base unit; unknown units leave it as it is."""
    return quantity * F.coalesce(base_factor(unit), F.lit(1.0))


def unit_family(unit: Column) -> Column:
    return _lookup(base_unit(unit), FAMILY)


def inferred_base_unit(explicit: Column, purchase_quantity: Column) -> Column:
    """The explicit base unit, else by the pack: exactly 1000 is grams, more is millilitres, less is pieces."""
    guess = F.when(purchase_quantity == 1000, "g").when(purchase_quantity > 1000, "ml").otherwise("un")
    return F.coalesce(base_unit(explicit), guess)


def repaired_quantity(quantity: Column, unit: Column) -> Column:
    """A quantity below one in g or ml was divided by 1000 twice if a thousand times it is at least 500."""
    twice = (quantity >= 0.5) & (quantity < 1) & base_unit(unit).isin("g", "ml")
    return F.when(twice, quantity * 1000).otherwise(quantity)


def density_quantity(quantity: Column, unit: Column, target: Column, density_g_per_ml: Column) -> Column:
    """Quantity in the target base unit, between g and ml only with a density."""
    own = base_unit(unit)
    amount = base_quantity(quantity, unit)
    return (
        F.when(own == target, amount)
        .when((own == "ml") & (target == "g") & (density_g_per_ml > 0), amount * density_g_per_ml)
        .when((own == "g") & (target == "ml") & (density_g_per_ml > 0), amount / density_g_per_ml)
    )


def prep_line_cost(usage: Column, usage_unit: Column, batch_cost: Column, output: Column, output_unit: Column) -> Column:
    """Share of a batch's cost that the usage takes; null where the families differ or the batch yields nothing."""
    made = base_quantity(output, output_unit)
    same = F.coalesce(unit_family(usage_unit), F.lit("countable")) == F.coalesce(unit_family(output_unit), F.lit("countable"))
    return F.when(same & (made > 0), base_quantity(usage, usage_unit) / made * batch_cost)


def countable_line_cost(amount: Column, pack_price: Column, pieces: Column, per_piece: Column) -> Column:
    """Cost of an amount in g or ml of goods bought by the piece, each of per_piece g or ml; null where a number is missing or cannot be."""
    sound = (amount >= 0) & (pack_price >= 0) & (pieces > 0) & (per_piece > 0)
    return F.when(sound, amount / per_piece * (pack_price / pieces))
