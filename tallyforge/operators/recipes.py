"""Recipe costing: nested recipes, roll-up, margins, what-if and exposure.

Edges are recipe_id, ingredient_id or sub_recipe_id, quantity. Preps yield output_quantity, so a use of a prep is quantity over output
of its batch. Equal paths are merged level by level: the frontier never holds more rows than (recipe, prep) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import exact_sum, food_cost_pct, gross_margin_pct, impact_band, margin_label, monthly_exposure, unit_cost

MOST_LEVELS = 10


def closure(edges: DataFrame, recipes: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """root, recipe_id, depth (the least), batches: how much of each nested recipe's batch a root takes; the root itself at depth 0."""
    output = recipes.select(F.col("recipe_id").alias("sub_recipe_id"), "output_quantity")
    uses = edges.where(F.col("sub_recipe_id").isNotNull()).join(output, "sub_recipe_id")
    uses = uses.where(F.col("output_quantity") > 0).select("recipe_id", "sub_recipe_id", (F.col("quantity") / F.col("output_quantity")).alias("share")).persist()
    level = recipes.select(F.col("recipe_id").alias("root"), "recipe_id", F.lit(0).alias("depth"), F.lit(1.0).alias("batches"))
    found = level
    for depth in range(1, levels + 1):
        level = level.join(uses, "recipe_id").groupBy("root", F.col("sub_recipe_id").alias("recipe_id")).agg(
            F.lit(depth).alias("depth"), F.sum(F.col("batches") * F.col("share")).alias("batches")
        ).where(F.col("recipe_id") != F.col("root")).persist()
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.groupBy("root", "recipe_id").agg(F.min("depth").alias("depth"), F.sum("batches").alias("batches"))


def priced_lines(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Direct ingredient lines with their cost; a line whose ingredient has no price stays, unresolved."""
    cost = catalog.select("ingredient_id", unit_cost(F.col("current_price"), F.col("purchase_quantity")).alias("unit_cost"))
    lines = edges.where(F.col("ingredient_id").isNotNull()).select("recipe_id", "ingredient_id", "quantity").join(cost, "ingredient_id", "left")
    return lines.withColumn("line_cost", F.col("quantity") * F.col("unit_cost"))


def rolled_up(edges: DataFrame, recipes: DataFrame, catalog: DataFrame | None, nested: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """recipe_id, total_cost (null if nothing resolves), n_lines, n_unresolved over all levels; lines (recipe_id, line_cost) where they are priced otherwise than by the catalog."""
    nested = closure(edges, recipes) if nested is None else nested
    own = (priced_lines(edges, catalog) if lines is None else lines).groupBy("recipe_id").agg(
        F.sum("line_cost").alias("cost"), F.count(F.lit(1)).alias("n"), F.sum(F.col("line_cost").isNull().cast("int")).alias("open")
    )
    return nested.join(own, "recipe_id").groupBy(F.col("root").alias("recipe_id")).agg(
        F.sum(F.col("batches") * F.col("cost")).alias("total_cost"), F.sum("n").alias("n_lines"), F.sum("open").alias("n_unresolved")
    )


def margins(recipes: DataFrame, costs: DataFrame) -> DataFrame:
    """Dishes with margin, food cost share and health."""
    rows = recipes.where(F.col("type") == "dish").join(costs, "recipe_id", "left")
    margin = gross_margin_pct(F.col("selling_price"), F.col("total_cost"))
    return rows.withColumn("margin_pct", margin).withColumn("food_cost_pct", food_cost_pct(F.col("selling_price"), F.col("total_cost"))).withColumn("health", margin_label(F.col("margin_pct")))


def all_lines(edges: DataFrame, recipes: DataFrame, catalog: DataFrame, costs: DataFrame) -> DataFrame:
    """recipe_id, kind, component_id, line_cost of ingredient and prep lines."""
    direct = priced_lines(edges, catalog).select("recipe_id", F.lit("ingredient").alias("kind"), F.col("ingredient_id").alias("component_id"), "line_cost")
    batch = recipes.join(costs, "recipe_id").select(F.col("recipe_id").alias("sub_recipe_id"), "output_quantity", "total_cost")
    prep = edges.where(F.col("sub_recipe_id").isNotNull()).select("recipe_id", "sub_recipe_id", "quantity").join(batch, "sub_recipe_id", "left").select(
        "recipe_id", F.lit("prep").alias("kind"), F.col("sub_recipe_id").alias("component_id"), (F.col("quantity") / F.col("output_quantity") * F.col("total_cost")).alias("line_cost")
    )
    return direct.unionByName(prep)


def top_lines(lines: DataFrame) -> DataFrame:
    """Each recipe's dearest line and its share of the recipe's cost."""
    per = Window.partitionBy("recipe_id")
    rank = F.row_number().over(per.orderBy(F.desc(F.round("line_cost", 6)), "kind", "component_id"))
    shared = lines.withColumn("_total", F.sum("line_cost").over(per)).withColumn("_n", rank)
    return shared.where((F.col("_n") == 1) & (F.col("_total") > 0)).withColumn("share_pct", F.col("line_cost") / F.col("_total") * 100).drop("_n", "_total")


def what_if(edges: DataFrame, recipes: DataFrame, catalog: DataFrame, new_price: Column) -> DataFrame:
    """Dishes whose cost a price change moves: old and new cost and margin, the drop and its band. new_price is a column over the catalog."""
    nested = closure(edges, recipes)
    old = rolled_up(edges, recipes, catalog, nested).select("recipe_id", F.col("total_cost").alias("old_cost"))
    new = rolled_up(edges, recipes, catalog.withColumn("current_price", new_price), nested).select("recipe_id", F.col("total_cost").alias("new_cost"))
    rows = recipes.where(F.col("type") == "dish").join(old, "recipe_id").join(new, "recipe_id").where(F.abs(F.col("new_cost") - F.col("old_cost")) > 1e-9)
    before, after = gross_margin_pct(F.col("selling_price"), F.col("old_cost")), gross_margin_pct(F.col("selling_price"), F.col("new_cost"))
    return rows.withColumn("margin_drop", before - after).withColumn("impact", impact_band(F.col("margin_drop")))


def affected(edges: DataFrame, recipes: DataFrame, changed: DataFrame) -> DataFrame:
    """Recipes that use a changed ingredient at any level, with how many of them."""
    direct = edges.where(F.col("ingredient_id").isNotNull()).join(changed.select("ingredient_id").distinct(), "ingredient_id", "left_semi").select("recipe_id", "ingredient_id")
    hit = closure(edges, recipes).join(direct, "recipe_id").groupBy(F.col("root").alias("recipe_id")).agg(F.countDistinct("ingredient_id").alias("n_ingredients"))
    return hit.join(recipes.select("recipe_id", "type"), "recipe_id")


def exposure(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Line cost of each ingredient over all recipes, its share, the recipes that use it and the modelled monthly cost."""
    used = priced_lines(edges, catalog).groupBy("ingredient_id").agg(exact_sum(F.col("line_cost")).alias("line_cost"), F.countDistinct("recipe_id").alias("n_recipes"))
    whole = used.agg(exact_sum(F.col("line_cost"))).first()[0] or 0.0
    share = F.when(F.lit(whole) > 0, F.col("line_cost") / F.lit(whole) * 100)
    return used.withColumn("share_pct", share).withColumn("monthly", monthly_exposure(F.col("line_cost"), F.col("n_recipes")))
