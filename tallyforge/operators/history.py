"""Price history: chains, guards, windows and volatility. Rows need ingredient_id, chrono, unit_price and a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import EPSILON, exact_mean, pct_change, ratio

HARD_RATIO = 14.0
FORMAT_RATIO = 2.0


def contract(unit_family: Column, form: Column) -> Column:
    """Rows are comparable purchases if their contracts agree."""
    return F.concat_ws(":", unit_family, form)


def guard_reason(before: Column, after: Column) -> Column:
    """Why a price may not chain to the one before it; null if it may. Structs with family, preservation, contract and unit_price."""
    apart = ratio(before["unit_price"], after["unit_price"])
    known = (before["preservation"] != "unknown") & (after["preservation"] != "unknown")
    return (
        F.when(before.isNull(), F.lit(None).cast("string"))
        .when(before["family"] != after["family"], "unit_family_mismatch")
        .when(known & (before["preservation"] != after["preservation"]), "preservation_mismatch")
        .when(apart > HARD_RATIO, "extreme_price_ratio")
        .when((before["contract"] != after["contract"]) & (apart > FORMAT_RATIO), "format_change")
    )


def guarded_chain(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds previous_price (null where the guard breaks the chain) and reason. The row before is the row before, compatible or not."""
    own = F.struct("family", "preservation", "contract", "unit_price")
    before = F.lag("_own").over(Window.partitionBy("ingredient_id").orderBy(*order))
    chained = rows.withColumn("_own", own).withColumn("_before", before)
    reason = guard_reason(F.col("_before"), F.col("_own"))
    chained = chained.withColumn("reason", reason)
    return chained.withColumn("previous_price", F.when(F.col("reason").isNull(), F.col("_before.unit_price"))).drop("_own", "_before")


def latest_moves(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The newest row of each ingredient with the price before and the change; one sort finds both."""
    chain = Window.partitionBy("ingredient_id").orderBy(*order)
    marked = rows.withColumn("previous_price", F.lag("unit_price").over(chain)).withColumn("_later", F.lead("ingredient_id").over(chain))
    newest = marked.where(F.col("_later").isNull()).drop("_later")
    return newest.withColumn("delta", F.col("unit_price") - F.col("previous_price")).withColumn("delta_pct", pct_change(F.col("previous_price"), F.col("unit_price")))


def previous_unit_price(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each ingredient's price before its newest: the newest row's own, else the second row's new price."""
    newest = F.row_number().over(Window.partitionBy("ingredient_id").orderBy(*[F.col(c).desc() for c in order]))
    two = rows.withColumn("_n", newest).where(F.col("_n") <= 2)
    first, second = F.max(F.when(F.col("_n") == 1, F.col("previous_price"))), F.max(F.when(F.col("_n") == 2, F.col("unit_price")))
    return two.groupBy("ingredient_id").agg(F.coalesce(first, second).alias("previous_unit_price"))


def since(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col("chrono") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def window_stats(rows: DataFrame, as_of: Column, windows: Sequence[int] = (90, 180)) -> DataFrame:
    """Count, least, greatest and mean of the positive prices of each ingredient in each window."""
    recent = since(rows, as_of, max(windows)).where(F.col("unit_price") > 0)
    found = []
    for days in windows:
        price = F.when(F.col("chrono") >= as_of - F.expr(f"INTERVAL {days} DAYS"), F.col("unit_price"))
        found += [F.count(price).alias(f"n_{days}"), F.min(price).alias(f"min_{days}"), F.max(price).alias(f"max_{days}"), exact_mean(price).alias(f"avg_{days}")]
    return recent.groupBy("ingredient_id").agg(*found)


def volatile_by_frequency(rows: DataFrame, as_of: Column, days: int = 90, least: int = 4, limit: int = 25) -> DataFrame:
    """Ingredients with many price rows lately."""
    counted = since(rows, as_of, days).groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_changes"))
    return counted.where(F.col("n_changes") >= least).orderBy(F.desc("n_changes"), "ingredient_id").limit(limit)


def volatile_by_range(rows: DataFrame, as_of: Column, days: int = 180, least: int = 3, share: float = 0.15) -> DataFrame:
    """Ingredients whose prices lie far apart."""
    found = since(rows, as_of, days).where(F.col("unit_price") > 0).groupBy("ingredient_id").agg(
        F.count(F.lit(1)).alias("n_prices"), F.min("unit_price").alias("least"), F.max("unit_price").alias("most")
    )
    spread = (F.col("most") - F.col("least")) / F.col("least")
    return found.withColumn("spread", spread).where((F.col("n_prices") >= least) & (F.col("spread") >= share))


def largest_increases(rows: DataFrame, as_of: Column, order: Sequence[str], days: int = 90, limit: int = 25) -> DataFrame:
    up = since(rows, as_of, days).where(F.col("delta") > EPSILON)
    return up.orderBy(F.desc("delta"), "ingredient_id", *order).limit(limit)


def strongest_moves(rows: DataFrame, as_of: Column, order: Sequence[str], days: int = 7, least: float = 0.5, limit: int = 8) -> DataFrame:
    """Each ingredient's largest move in the window, by size."""
    moved = since(rows, as_of, days).where(F.abs("delta_pct") >= least)
    best = F.row_number().over(Window.partitionBy("ingredient_id").orderBy(F.desc(F.abs("delta_pct")), *order))
    return moved.withColumn("_n", best).where(F.col("_n") == 1).drop("_n").orderBy(F.desc(F.abs("delta_pct")), "ingredient_id").limit(limit)


def variability(rows: DataFrame, least: int = 2, stable_below: float = 0.06) -> DataFrame:
    """Coefficient of variation of each ingredient's prices."""
    found = rows.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_prices"), F.avg("unit_price").alias("mean"), F.stddev_pop("unit_price").alias("spread"))
    cv = F.when(F.col("mean") > 0, F.col("spread") / F.col("mean"))
    return found.where(F.col("n_prices") >= least).withColumn("cv", cv).withColumn("stable", F.coalesce(F.col("cv") < stable_below, F.lit(False)))
