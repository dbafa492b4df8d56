"""Suppliers: windows, watchlist, switches, drift and trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import EPSILON, pct_change
from tallyforge.operators.history import since


def in_window(rows: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Per supplier: mean move, price events, invoices, spend, and the ingredients that moved most up and down."""
    recent = since(rows, as_of, days)
    moved = F.col("delta_pct")
    rounded = F.round(moved, 6)
    return recent.groupBy("supplier_name").agg(
        F.avg(moved).alias("avg_pct"), F.count(moved).alias("n_events"), F.countDistinct("invoice_id").alias("n_invoices"), F.sum("total").alias("spend"),
        F.max_by("ingredient_id", F.when(moved > 0, F.struct(rounded, -F.col("ingredient_id")))).alias("top_up"),
        F.max_by("ingredient_id", F.when(moved < 0, F.struct(-rounded, -F.col("ingredient_id")))).alias("top_down"),
    )


def watchlist(rows: DataFrame, as_of: Column, days: int = 90, least: float = 0.5) -> DataFrame:
    """Per supplier: how many prices rose and fell, the largest move, and the status and risk that follow."""
    moved = since(rows, as_of, days).where(F.abs("delta_pct") >= least)
    found = moved.groupBy("supplier_name").agg(
        F.count_if(F.col("delta_pct") > 0).alias("n_up"), F.count_if(F.col("delta_pct") < 0).alias("n_down"), F.max(F.abs("delta_pct")).alias("max_pct")
    )
    status = F.when(F.col("n_up") > F.col("n_down"), "rising").when(F.col("n_up") < F.col("n_down"), "easing").otherwise("mixed")
    risk = F.when((F.col("max_pct") >= 15) & (F.col("n_up") > 0), "high").when(F.col("max_pct") >= 5, "medium").otherwise("low")
    return found.withColumn("status", status).withColumn("risk", risk)


def switches(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Consecutive purchases of an ingredient from different suppliers, with the price change and its kind."""
    chain = Window.partitionBy("ingredient_id").orderBy(*order)
    both = rows.withColumn("from_supplier", F.lag("supplier_name").over(chain)).withColumn("from_price", F.lag("unit_price").over(chain))
    moved = both.where(F.col("from_supplier") != F.col("supplier_name")).withColumn("change_pct", pct_change(F.col("from_price"), F.col("unit_price")))
    kind = F.when(F.col("change_pct") > 2, "dearer").when(F.col("change_pct") < -2, "cheaper").when(F.col("change_pct").isNotNull(), "stable")
    return moved.withColumn("kind", kind)


def drift(rows: DataFrame, as_of: Column, order: Sequence[str], days: int = 180, least: int = 4) -> DataFrame:
    """Per supplier: mean price of the earlier and the later half of its rows, and the share of rises."""
    recent = since(rows, as_of, days)
    per = Window.partitionBy("supplier_name")
    halves = recent.withColumn("_k", F.row_number().over(per.orderBy("chrono", "ingredient_id", *[c for c in order if c != "chrono"]))).withColumn("_n", F.count(F.lit(1)).over(per))
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    found = halves.where(F.col("_n") >= least).groupBy("supplier_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(early, F.col("unit_price"))).alias("early_avg"), F.avg(F.when(~early, F.col("unit_price"))).alias("late_avg"),
        F.count_if(F.col("delta") > EPSILON).alias("n_rises"), F.countDistinct("ingredient_id").alias("n_ingredients"),
    )
    moved = F.when(F.col("early_avg") > EPSILON, (F.col("late_avg") - F.col("early_avg")) / F.col("early_avg")).otherwise(0.0)
    return found.withColumn("drift", moved).withColumn("rise_ratio", F.col("n_rises") / F.col("n_rows"))


def temporal_trend(rows: DataFrame, as_of: Column) -> DataFrame:
    """Per supplier: mean move of the last 30 days against that of the 60 before; 3 points apart is a trend."""
    recent = since(rows, as_of, 90)
    late = F.col("chrono") >= as_of - F.expr("INTERVAL 30 DAYS")
    found = recent.groupBy("supplier_name").agg(F.avg(F.when(late, F.col("delta_pct"))).alias("late_pct"), F.avg(F.when(~late, F.col("delta_pct"))).alias("early_pct"))
    gap = F.col("late_pct") - F.col("early_pct")
    trend = F.when(gap.isNull(), "unknown").when(gap >= 3, "accelerating").when(gap <= -3, "easing").otherwise("steady")
    return found.withColumn("trend", trend)
