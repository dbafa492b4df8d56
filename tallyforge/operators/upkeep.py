"""Upkeep of a price history and its signals: deleted invoices, repeated prices, implausible packs, signals of one ingredient, servings of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import pct_change

PRICE_EPS = 1e-6
# Dearest plausible litre, smallest plausible pack.
MOST_A_LITRE = 50.0
LEAST_PACK_ML = 50.0
SEVERITIES = ("high", "medium", "low")


def relinked_after_delete(rows: DataFrame, deleted: DataFrame, order: Sequence[str]) -> DataFrame:
    """The chains of the ingredients that a deleted invoice held, linked anew without its lines.

    Only those ingredients are read: a semi join comes before the window. deleted: invoice_id; an invoice named twice counts once.
    """
    touched = rows.join(deleted, "invoice_id", "left_semi").select("ingredient_id").distinct()
    left = rows.join(touched, "ingredient_id", "left_semi").join(deleted, "invoice_id", "left_anti")
    before = F.lag("unit_price").over(Window.partitionBy("ingredient_id").orderBy(*order))
    linked = left.withColumn("previous_price", before)
    return linked.withColumn("delta", F.col("unit_price") - F.col("previous_price")).withColumn("delta_pct", pct_change(F.col("previous_price"), F.col("unit_price")))


def prices_unchanged(previous_pack: Column, previous_quantity: Column, pack: Column, quantity: Column) -> Column:
    """Whether two purchases cost the same a unit; where a unit price is unknown, whether the packs cost the same. False without an earlier pack."""

    def per_unit(price: Column, n: Column) -> Column:
        return F.when((price > 0) & (n > 0), price / n)

    by_unit = F.abs(per_unit(previous_pack, previous_quantity) - per_unit(pack, quantity)) <= PRICE_EPS
    return F.coalesce(by_unit, F.abs(previous_pack - pack) <= PRICE_EPS, F.lit(False))


def implausible_volume(price: Column, millilitres: Column) -> Column:
    """Whether a pack of liquid is too dear a litre or too small to be true; false where it is no liquid (null millilitres)."""
    held = F.when(millilitres > 0, millilitres)
    return F.coalesce((price / held * 1000 > MOST_A_LITRE) | (held < LEAST_PACK_ML), F.lit(False))


def deduped_signals(signals: DataFrame) -> DataFrame:
    """One signal of each ingredient, or of itself where it names none: severest, then highest priority, then smallest signal_id; positive ones are no signals.

    signals: signal_id, ingredient_id, severity, priority. A combining aggregate, so an ingredient with very many signals is no burden.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    kept = signals.where(rank > 0).withColumn("key", F.coalesce(F.col("ingredient_id").cast("string"), F.concat(F.lit("signal:"), F.col("signal_id").cast("string"))))
    best = F.min_by(F.struct("signal_id", "ingredient_id", "severity", "priority"), F.struct(rank, -F.col("priority"), F.col("signal_id")))
    return kept.groupBy("key").agg(best.alias("s")).select("s.*")


def servings(output: Column, serving: Column) -> Column:
    """Servings of a batch; null unless both amounts are positive."""
    return F.when((output > 0) & (serving > 0), output / serving)
