"""Catalog and match quality: duplicates, orphans, collisions, merges, coverage and dual reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(catalog: DataFrame, key: Column, id_column: str = "ingredient_id") -> DataFrame:
    """Keys that two or more entries share, with their number and least id."""
    grouped = catalog.where(key.isNotNull() & (key != "")).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_entries"), F.min(id_column).alias("least_id"))
    return grouped.where(F.col("n_entries") >= 2)


def reference_counts(catalog: DataFrame, references: Mapping[str, DataFrame], id_column: str = "ingredient_id") -> DataFrame:
    """Rows of each table that refer to each entry, 0 where none does."""
    tagged = [rows.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name)) for name, rows in references.items()]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    counts = every.groupBy(id_column).agg(*[F.sum(F.when(F.col("source") == name, F.col("n")).otherwise(0)).alias(f"n_{name}") for name in references])
    return catalog.select(id_column).join(counts, id_column, "left").fillna(0)


def orphans(counts: DataFrame) -> DataFrame:
    """Entries nothing refers to."""
    used = [c for c in counts.columns if c.startswith("n_")]
    total = sum((F.col(c) for c in used), F.lit(0))
    return counts.where(total == 0)


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Aliases that lead to two or more different entries, within a supplier and without one."""
    return aliases.groupBy("supplier_name", "normalized_alias").agg(F.countDistinct("ingredient_id").alias("n_ingredients"), F.min("ingredient_id").alias("least_id")).where(F.col("n_ingredients") >= 2)


def merge_plan(catalog: DataFrame, key: Column, counts: DataFrame, id_column: str = "ingredient_id") -> DataFrame:
    """key, survivor, merged id of every entry that goes: the entry with most references stays, then that of the least id."""
    used = [c for c in counts.columns if c.startswith("n_")]
    rows = catalog.withColumn("key", key).join(counts.select(id_column, sum((F.col(c) for c in used), F.lit(0)).alias("references")), id_column)
    best = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by(id_column, F.struct("references", -F.col(id_column))).alias("survivor")).where(F.col("n") >= 2)
    return rows.join(best, "key").where(F.col(id_column) != F.col("survivor")).select("key", "survivor", F.col(id_column).alias("merged_id"), "references")


def dual_read(virtual: DataFrame, persisted: DataFrame) -> DataFrame:
    """item_id, alignment: what a computed match (item_id, ingredient_id) and a stored one say to each other."""
    v, p = virtual.select("item_id", F.col("ingredient_id").alias("v")), persisted.select("item_id", F.col("ingredient_id").alias("p"), F.lit(True).alias("stored"))
    both = v.join(p, "item_id", "full_outer")
    alignment = (
        F.when(F.col("stored").isNull(), "missing")
        .when(F.col("v").isNull() & F.col("p").isNull(), "aligned_unmatched")
        .when(F.col("v") == F.col("p"), "aligned")
        .when(F.col("v").isNull(), "stored_only")
        .when(F.col("p").isNull(), "computed_only")
        .otherwise("different")
    )
    return both.withColumn("alignment", alignment).withColumn("effective_id", F.when(F.col("stored"), F.col("p")).otherwise(F.col("v")))


def coverage(item_ids: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: items without a match, matches without an item, and items with several."""
    held = matches.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    both = item_ids.select("item_id").distinct().withColumn("item", F.lit(True)).join(held, "item_id", "full_outer")
    return both.agg(
        F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("item").isNull()).alias("n_orphan"), F.count_if(F.col("n") > 1).alias("n_duplicate")
    )


def latest_state(changes: DataFrame, key: str = "item_id", order: str = "at") -> DataFrame:
    """The newest change of each key."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return changes.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")
