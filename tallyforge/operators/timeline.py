"""Purchase timelines: labels of single purchases, the trend they make, and what a change of supplier did to the price's steadiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import exact_mean


def labelled(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds is_best, is_highest (the first of the least and greatest prices, if they differ), and for the newest purchase above_previous, above_average, switched."""
    per = Window.partitionBy("ingredient_id")
    chain = per.orderBy(*order)
    price = F.col("unit_price")
    marked = (
        rows.withColumn("_least", F.min(price).over(per)).withColumn("_most", F.max(price).over(per)).withColumn("_mean", F.avg(price).over(per))
        .withColumn("_before", F.lag(price).over(chain)).withColumn("_from", F.lag("supplier_name").over(chain)).withColumn("_later", F.lead(F.lit(1)).over(chain))
    )
    first_of_price = F.row_number().over(Window.partitionBy("ingredient_id", "unit_price").orderBy(*order)) == 1
    newest = F.col("_later").isNull() & F.col("_before").isNotNull()
    differ = F.col("_most") > F.col("_least")
    return marked.withColumns({
        "is_best": differ & (price == F.col("_least")) & first_of_price,
        "is_highest": differ & (price == F.col("_most")) & first_of_price,
        "above_previous": newest & (price > F.col("_before") * 1.03),
        "above_average": newest & (price > F.col("_mean") * 1.03),
        "switched": newest & (F.col("_from") != F.col("supplier_name")),
    }).drop("_least", "_most", "_mean", "_before", "_from", "_later")


def compact_trend(rows: DataFrame, order: Sequence[str], volatile_from: float = 0.10) -> DataFrame:
    """One state per ingredient, by the first rule that holds: volatile, recently-increased, rising, improving, rising above the lowest, stable."""
    chain = Window.partitionBy("ingredient_id").orderBy(*[F.col(c).desc() for c in order])
    numbered = rows.withColumn("_n", F.row_number().over(chain))
    price = F.col("unit_price")
    found = numbered.groupBy("ingredient_id").agg(
        F.count(F.lit(1)).alias("n_purchases"), F.max(F.when(F.col("_n") == 1, price)).alias("current"), F.max(F.when(F.col("_n") == 2, price)).alias("prior"),
        exact_mean(price).alias("mean"), F.min(price).alias("least"), F.max(price).alias("most"),
    )
    now, n = F.col("current"), F.col("n_purchases")
    state = (
        F.when((n >= 2) & (F.col("least") > 0) & ((F.col("most") - F.col("least")) / F.col("least") >= volatile_from), "volatile")
        .when(now > F.col("prior") * 1.03, "recently-increased")
        .when((n >= 3) & (now > F.col("mean") * 1.05), "rising")
        .when((n >= 3) & (now < F.col("mean") * 0.95), "improving")
        .when(now > F.col("least") + 0.001, "rising")
        .when(n >= 2, "stable")
    )
    return found.withColumn("state", state)


def steadier_after_switch(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Switches of supplier after which the moves of the new supplier's prices spread much less than all moves before."""
    per = Window.partitionBy("ingredient_id")
    chain = per.orderBy(*order)
    moved = F.coalesce("delta_pct", F.lit(0.0))
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("ingredient_id", "supplier_name").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marked = rows.withColumns({
        "from_supplier": F.lag("supplier_name").over(chain),
        "n_before": F.count(F.lit(1)).over(before), "spread_before": F.stddev_pop(moved).over(before),
        "n_after": F.count(F.lit(1)).over(after), "spread_after": F.stddev_pop(moved).over(after),
    })
    calmer = (F.col("spread_before") >= 4) & (F.col("spread_after") <= F.col("spread_before") * 0.55) & (F.col("spread_after") <= 2.5)
    return marked.where((F.col("from_supplier") != F.col("supplier_name")) & (F.col("n_before") >= 2) & (F.col("n_after") >= 2) & calmer)


def movement_signal(window: DataFrame, meaningful: float = 2.0) -> DataFrame:
    """Adds signal to rows of avg_pct, spread, n_events and trend."""
    size = F.abs("avg_pct")
    quiet = (size < meaningful) & (F.col("n_events") >= 2)
    signal = (
        F.when(quiet & (F.col("trend") == "easing") & (F.col("spread") >= 4), "stabilizing_after_volatility")
        .when(quiet & (F.col("spread") <= 1.5), "improving_consistency")
        .when(quiet, "stable_pricing")
        .when((F.col("avg_pct") >= meaningful) & ((F.col("trend") == "accelerating") | (F.col("n_events") >= 2)), "sustained_increase")
        .when((F.col("trend") == "easing") & (size >= meaningful), "stabilizing_after_volatility")
        .when(F.col("avg_pct") >= meaningful, "sustained_increase")
        .otherwise("stable_pricing")
    )
    return window.withColumn("signal", signal)
