"""Merges of catalog entries and the tables they rewrite; each with the DuckDB SQL that must return the same rows.

Entries of one name are merged; besides, each 37th entry was merged by hand with the entry whose id is 5 larger, if there is one, which links names with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import merging
from tallyforge.plans.oracles import KITCHEN
from tallyforge.plans.match_queries import NAMES
from tallyforge.sources import texts, views


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.recipe_edges(spark, sf_dir).where(F.col("ingredient_id").isNotNull()).select("ingredient_id")
    bought = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ingredient_id"))
    return edges.unionByName(bought).groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("references"))


def merge_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every merged entry becomes."""
    catalog = views.ingredients(spark, sf_dir).select("ingredient_id", "name")
    least = catalog.groupBy("name").agg(F.min("ingredient_id").alias("b"))
    named = catalog.join(least, "name").select(F.col("ingredient_id").alias("a"), "b")
    by_hand = catalog.where(F.col("ingredient_id") % 37 == 0).select(F.col("ingredient_id").alias("a"), (F.col("ingredient_id") + 5).alias("b"))
    by_hand = by_hand.join(catalog.select(F.col("ingredient_id").alias("b")), "b", "left_semi")
    return merging.id_map(named.unionByName(by_hand.select("a", "b")), _references(spark, sf_dir))


def merged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merged_catalog(views.ingredients(spark, sf_dir).select("ingredient_id", "name"), merge_id_map(spark, sf_dir))


def merged_recipe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe lines after the merge; lines of one recipe that now use one entry are one."""
    rows = views.recipe_edges(spark, sf_dir).where(F.col("ingredient_id").isNotNull()).select("recipe_id", "ingredient_id", "quantity")
    rows = merging.rewritten(rows, merge_id_map(spark, sf_dir))
    return rows.groupBy("recipe_id", "ingredient_id").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines"), F.count_if("was_rewritten").alias("n_rewritten"))


def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases after the merge: those that had named several entries of one kind now name one."""
    rows = merging.rewritten(texts.written_aliases(spark, sf_dir), merge_id_map(spark, sf_dir))
    return rows.groupBy("supplier_name", "normalized_alias", "ingredient_id").agg(F.max("confirmed").alias("confirmed"))


def merged_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of every entry after the merge, with how many came from others."""
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ingredient_id"), "l_quantity")
    rows = merging.rewritten(rows, merge_id_map(spark, sf_dir))
    return rows.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("was_rewritten").alias("n_rewritten"), F.sum("l_quantity").alias("quantity"))


def merged_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' matches of house blends after the merge."""
    rows = texts.written_names(spark, sf_dir).where("is_entry AND form = 7").select("line_id", F.col("part_id").alias("ingredient_id"))
    return merging.rewritten(rows, merge_id_map(spark, sf_dir))


IDS = f"""{KITCHEN},
    hand AS (SELECT a.ingredient_id AS a, b.ingredient_id AS b, a.name AS x, b.name AS y FROM ing a JOIN ing b ON b.ingredient_id = a.ingredient_id + 5 WHERE a.ingredient_id % 37 = 0),
    rch AS (SELECT name AS x, name AS y FROM ing UNION SELECT rch.x, h.y FROM rch JOIN (SELECT x, y FROM hand UNION SELECT y, x FROM hand) h ON h.x = rch.y),
    grp AS (SELECT x AS name, min(y) AS g FROM rch GROUP BY 1),
    rf AS (SELECT ingredient_id, g, (SELECT count(*) FROM edges e WHERE e.ingredient_id = ing.ingredient_id) + (SELECT count(*) FROM lineitem WHERE l_partkey = ing.ingredient_id) AS n FROM ing JOIN grp USING (name)),
    srv AS (SELECT g, ingredient_id AS target_id FROM rf QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, ingredient_id) = 1),
    im AS (SELECT ingredient_id AS source_id, target_id FROM rf JOIN srv USING (g) WHERE ingredient_id <> target_id)"""

ORACLE_SQL: dict[str, str] = {
    "merge_id_map": f"WITH RECURSIVE {IDS} SELECT * FROM im",
    "merged_catalog": f"WITH RECURSIVE {IDS} SELECT ingredient_id, name, target_id AS merged_into_ingredient_id, target_id IS NOT NULL AS is_archived FROM ing LEFT JOIN im ON source_id = ingredient_id",
    "merged_recipe_edges": f"""
        WITH RECURSIVE {IDS} SELECT recipe_id, coalesce(target_id, ingredient_id) AS ingredient_id, sum(quantity) AS quantity, count(*) AS n_lines, count(target_id) AS n_rewritten
        FROM edges LEFT JOIN im ON source_id = ingredient_id WHERE ingredient_id IS NOT NULL GROUP BY 1, 2""",
    "merged_aliases": f"""
        WITH RECURSIVE {IDS}, {NAMES.strip()} SELECT supplier_name, alias AS normalized_alias, coalesce(target_id, ingredient_id) AS ingredient_id, bool_or(confirmed) AS confirmed FROM al LEFT JOIN im ON source_id = ingredient_id GROUP BY 1, 2, 3""",
    "merged_purchases": f"""
        WITH RECURSIVE {IDS} SELECT coalesce(target_id, l_partkey) AS ingredient_id, count(*) AS n_lines, count(target_id) AS n_rewritten, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN im ON source_id = l_partkey GROUP BY 1""",
    "merged_overrides": f"""
        WITH RECURSIVE {IDS}, {NAMES.strip()} SELECT line_id, coalesce(target_id, p_partkey) AS ingredient_id, target_id IS NOT NULL AS was_rewritten FROM ln LEFT JOIN im ON source_id = p_partkey WHERE is_entry AND v = 7""",
}
