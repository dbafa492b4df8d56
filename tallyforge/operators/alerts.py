"""Detectors, and the ranking of what they find. Every detector gives kind, subject_id, severity (high, medium, low) and priority."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import EPSILON
from tallyforge.operators.suppliers import drift

SEVERITIES = ("high", "medium", "low")


def spikes(rows: DataFrame, as_of: Column, recent_days: int = 14, limit: int = 25) -> DataFrame:
    """Ingredients whose largest recent rise stands out, absolutely or against their older rises' upper median."""
    cut = as_of - F.expr(f"INTERVAL {recent_days} DAYS")
    rises = rows.where((F.col("delta_pct") > 0) & (F.col("delta") > EPSILON)).withColumn("recent", F.col("chrono") >= cut)
    top = rises.where("recent").groupBy("ingredient_id").agg(F.max(F.struct("delta_pct", "delta")).alias("m")).select("ingredient_id", F.col("m.delta_pct").alias("pct"), F.col("m.delta").alias("delta"))
    per = Window.partitionBy("ingredient_id")
    older = rises.where(~F.col("recent")).withColumn("_k", F.row_number().over(per.orderBy("delta_pct")) - 1).withColumn("samples", F.count(F.lit(1)).over(per))
    base = older.where(F.col("_k") == F.floor(F.col("samples") / 2)).select("ingredient_id", "samples", F.col("delta_pct").alias("baseline"))
    both = top.join(base, "ingredient_id", "left").fillna({"samples": 0, "baseline": 0.0})
    over = F.col("pct") - F.col("baseline")
    strong = (F.col("pct") >= 18) | (F.col("delta") >= 0.08)
    told = strong | ((F.col("samples") >= 2) & (over >= 10)) | ((F.col("pct") >= 12) & ((F.col("samples") == 0) | (over >= 5)))
    severity = F.when((F.col("pct") >= 28) | (F.col("delta") >= 0.2), "high").when(F.col("pct") >= 18, "medium").otherwise("low")
    return both.where(told).withColumn("severity", severity).orderBy(F.desc(F.round("pct", 6)), "ingredient_id").limit(limit)


def supplier_trends(rows: DataFrame, as_of: Column, order: Sequence[str], days: int = 180, limit: int = 4) -> DataFrame:
    found = drift(rows, as_of, order, days).where((F.col("drift") > 0.025) | (F.col("rise_ratio") >= 0.5))
    pct = F.col("drift") * 100
    severity = F.when((pct > 8) | (F.col("rise_ratio") >= 0.65), "high").when(pct > 4, "medium").otherwise("low")
    return found.withColumn("severity", severity).orderBy(F.desc("n_rows"), "supplier_name").limit(limit)


def monthly_loss(lines: DataFrame, moves: DataFrame, least: float = 0.08) -> DataFrame:
    """One row: what the latest rises add to the portions of the recipes they touch."""
    rise = moves.where(F.col("delta_pct") > 0).select("ingredient_id", "delta_pct")
    added = lines.join(rise, "ingredient_id").withColumn("added", F.col("line_cost") * F.col("delta_pct") / 100)
    total = added.agg(F.coalesce(F.sum("added"), F.lit(0.0)).alias("total"), F.countDistinct("recipe_id").alias("n_recipes"))
    severity = F.when(F.col("total") >= 5, "high").when(F.col("total") >= 2, "medium").otherwise("low")
    return total.where(F.col("total") >= least).withColumn("severity", severity)


def below_target(margins: DataFrame, target: float = 65.0, critical: float = 55.0) -> DataFrame:
    low = margins.where(F.col("margin_pct") < target)
    return low.select(
        F.lit("below_target").alias("kind"), F.col("recipe_id").alias("subject_id"), F.when(F.col("margin_pct") < critical, "high").otherwise("medium").alias("severity"),
        F.round(target - F.col("margin_pct"), 4).alias("priority"),
    )


def concentration(top: DataFrame, least: float = 55.0) -> DataFrame:
    return top.where(F.col("share_pct") >= least).select(
        F.lit("concentration").alias("kind"), F.col("recipe_id").alias("subject_id"), F.when(F.col("share_pct") >= 80, "medium").otherwise("low").alias("severity"),
        F.round("share_pct", 4).alias("priority"),
    )


def stale(freshness: DataFrame, least: int = 45, limit: int = 4) -> DataFrame:
    old = freshness.where(F.col("days") >= least)
    return old.select(
        F.lit("stale").alias("kind"), F.col("ingredient_id").alias("subject_id"), F.when(F.col("days") >= 180, "medium").otherwise("low").alias("severity"), F.col("days").cast("double").alias("priority")
    ).orderBy(F.desc("priority"), "subject_id").limit(limit)


def ranked(found: Sequence[DataFrame], limit: int = 16) -> DataFrame:
    """All alerts together: one for each kind and subject, the most severe first, then by priority."""
    every = reduce(DataFrame.unionByName, found)
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    best = F.row_number().over(Window.partitionBy("kind", "subject_id").orderBy("_s", F.desc("priority")))
    one = every.withColumn("_s", order).withColumn("_n", best).where(F.col("_n") == 1)
    top = one.orderBy("_s", F.desc("priority"), "kind", "subject_id").limit(limit)
    place = F.row_number().over(Window.orderBy("_s", F.desc("priority"), "kind", "subject_id"))
    return top.withColumn("place", place).drop("_s", "_n")
