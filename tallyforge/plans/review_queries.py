"""The review queries: what a purchasing team looks through, over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import history, invoices, recipes, reviews
from tallyforge.plans.queries import _contracts, _costs, _exposed, _history, _kitchen, _lines, _top_lines, r4
from tallyforge.sources import tables, texts, views
from tallyforge.sources.views import PURCHASE_ORDER


def price_trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest ten purchases of every ingredient, oldest first."""
    rows = reviews.newest_points(views.purchase_lines(spark, sf_dir), PURCHASE_ORDER, 10)
    return rows.select("ingredient_id", "point", "invoice_id", "supplier_name", "unit_price")


def available_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    return orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().orderBy(F.desc("month"))


def price_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews.price_extremes(views.purchase_lines(spark, sf_dir), PURCHASE_ORDER)
    return rows.select("ingredient_id", "low_price", "high_price", "low_supplier", "high_supplier")


def alert_recipe_deterioration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth ingredient ten percent dearer."""
    edges, made, catalog = _kitchen(spark, sf_dir)
    dearer = F.when(F.col("ingredient_id") % 10 == 0, F.col("current_price") * 1.1).otherwise(F.col("current_price"))
    return reviews.deteriorated(recipes.what_if(edges, made, catalog, dearer)).select("recipe_id", *r4("margin_drop", "cost_up"), "severity")


def alert_volatile_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, as_of = _lines(spark, sf_dir)
    return reviews.volatile_basket(history.volatile_by_frequency(rows, as_of, limit=12), views.recipe_edges(spark, sf_dir))


def supplier_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, as_of = _lines(spark, sf_dir)
    found = reviews.supplier_intelligence(_contracts(rows), PURCHASE_ORDER, as_of)
    return found.select("ingredient_id", *r4("latest", "mean_90"), "spike_pct", "better_supplier", "gap_pct", "is_stable")


def ingredient_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure, price windows and the cheapest and dearest supplier of every ingredient that a recipe uses."""
    exposed, _ = _exposed(spark, sf_dir)
    rows, as_of = _lines(spark, sf_dir)
    stats = history.window_stats(rows, as_of)
    ends = reviews.price_extremes(rows, PURCHASE_ORDER)
    both = exposed.join(stats, "ingredient_id", "left").join(ends, "ingredient_id", "left").fillna({"n_90": 0, "n_180": 0})
    return both.select("ingredient_id", "n_recipes", "monthly", "share_pct", "avg_90", "avg_180", "low_price", "high_price", "n_90", "n_180", "low_supplier", "high_supplier")


def cost_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts.catalog_texts(spark, sf_dir)
    return rows.select("id", text.cost_category(F.col("name")).alias("category"))


def price_history_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored prices of which every thirteenth invoice's is ten percent off and every seventeenth invoice has lost its lines."""
    rows = views.purchase_lines(spark, sf_dir).groupBy("invoice_id", "ingredient_id").agg(F.max_by("unit_price", F.struct(*PURCHASE_ORDER)).alias("unit_price"))
    stored = rows.select("invoice_id", "ingredient_id", F.when(F.col("invoice_id") % 13 == 0, F.col("unit_price") * 1.1).otherwise(F.col("unit_price")).alias("new_price"))
    found = reviews.history_repairs(stored, rows.where(F.col("invoice_id") % 17 != 0))
    return found.where("needs_repair OR skip_reason IS NOT NULL").select("invoice_id", "ingredient_id", "new_price", "expected_price", "needs_repair", "skip_reason")


def procurement_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = history.latest_moves(views.purchase_lines(spark, sf_dir), PURCHASE_ORDER)
    return reviews.synced_prices(views.ingredients(spark, sf_dir), latest).select("ingredient_id", "current_price", "new_price")


def recipe_link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large ingredients stand for entries outside the canonical catalog."""
    canonical = views.ingredients(spark, sf_dir).where(F.col("kind") != "LARGE")
    return reviews.recipe_link_audit(views.recipe_edges(spark, sf_dir), canonical).select("recipe_id", "ingredient_id", "quantity")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as matches: suppliers divisible by five leave lines unmatched, those divisible by seven only suggested."""
    line = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_partkey").alias("ingredient_id"), "l_suppkey")
    status = F.when(F.col("l_suppkey") % 5 == 0, "unmatched").when(F.col("l_suppkey") % 7 == 0, "suggested").otherwise("confirmed")
    return line.withColumn("status", status)


def match_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.match_progress(_matches(spark, sf_dir))


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are matched or suggested to each catalog entry."""
    held = _matches(spark, sf_dir).where(F.col("status") != "unmatched").groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return views.ingredients(spark, sf_dir).select("ingredient_id").join(held, "ingredient_id", "left").fillna({"n_lines": 0})


def match_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match state of every order after changes that confirm the even ones."""
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderstatus")
    state = orders.where(F.col("item_id") % 3 != 0).select("item_id", F.lit("suggested").alias("status"))
    first, second = orders.where(F.col("item_id") % 2 == 0), orders.where(F.col("item_id") % 4 == 0)
    changes = first.select("item_id", F.lit("confirmed").alias("status"), F.lit(1).alias("at")).unionByName(second.select("item_id", F.lit("corrected").alias("status"), F.lit(2).alias("at")))
    return tables.upserted(state, changes, "item_id", "at").select("item_id", "status")


def trusted_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each ingredient, where its move can be shown."""
    chain = history.guarded_chain(_contracts(views.purchase_lines(spark, sf_dir)), PURCHASE_ORDER)
    newest = reviews.newest_points(chain, PURCHASE_ORDER, 1)
    return reviews.trusted(newest).select("ingredient_id", "supplier_name", "unit_price", "previous_price")


def dominant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, as_of = _lines(spark, sf_dir)
    return reviews.dominant_window(rows, as_of)


def concentration_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    story = F.element_at(F.split("name", " "), -1)
    found = reviews.concentration_groups(_top_lines(spark, sf_dir), views.ingredients(spark, sf_dir), story)
    return found.select("story", "n_ingredients", "n_recipes", *r4("avg_share_pct"))


def alerts_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven local detectors together, the sixteen foremost alerts."""
    edges, made, catalog = _kitchen(spark, sf_dir)
    rows, as_of = _lines(spark, sf_dir)
    costs = _costs(edges, made, catalog).persist()
    goods = catalog.select("ingredient_id")
    usage = edges.where(F.col("ingredient_id").isNotNull()).groupBy("ingredient_id").agg(F.countDistinct("recipe_id").alias("n_recipes"))
    preps = edges.where(F.col("sub_recipe_id").isNotNull()).groupBy(F.col("sub_recipe_id").alias("recipe_id")).agg(F.countDistinct("recipe_id").alias("n_parents"))
    chain = history.guarded_chain(_contracts(rows).join(goods, "ingredient_id", "left_semi"), PURCHASE_ORDER)
    latest = reviews.newest_points(chain, PURCHASE_ORDER, 1).withColumn("delta_pct", (F.col("unit_price") / F.col("previous_price") - 1) * 100).persist()
    prices = reviews.price_alerts(reviews.trusted(latest), usage).persist()
    found = [
        prices, reviews.margin_alerts(recipes.margins(made, costs)), reviews.share_alerts(recipes.top_lines(recipes.all_lines(edges, made, catalog, costs))), reviews.prep_alerts(preps),
        reviews.stale_alerts(invoices.pricing_freshness(catalog, rows, as_of), usage), reviews.recent_alerts(latest, prices, as_of),
    ]
    return reviews.ordered(found)


def menu_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, made, catalog = _kitchen(spark, sf_dir)
    exposed = recipes.exposure(edges, catalog).persist()
    kind = F.element_at(F.split("name", " "), -1).alias("category")
    slices = exposed.join(catalog.select("ingredient_id", kind), "ingredient_id").groupBy("category").agg(F.sum("share_pct").alias("share_pct"))
    tops = recipes.top_lines(recipes.all_lines(edges, made, catalog, _costs(edges, made, catalog)))
    dishes = made.where(F.col("type") == "dish").select("recipe_id")
    found = reviews.menu_dependencies(exposed.select("ingredient_id", "n_recipes"), slices, tops.join(dishes, "recipe_id", "left_semi"))
    return found.select("kind", "subject", *r4("weight"))


def margin_pressure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: dishes below target, what the rises of the last 30 days add a month, and the ingredient that adds most."""
    edges, made, catalog = _kitchen(spark, sf_dir)
    low = recipes.margins(made, _costs(edges, made, catalog)).agg(F.count_if(F.col("margin_pct") < 65).alias("n")).first()["n"]
    past, as_of = _history(spark, sf_dir)
    latest = history.since(history.latest_moves(views.purchase_lines(spark, sf_dir), PURCHASE_ORDER), as_of, 30).where(F.col("delta_pct") > 0).select("ingredient_id", "delta_pct")
    added = recipes.exposure(edges, catalog).join(latest, "ingredient_id").withColumn("added", F.round(F.col("monthly") * F.col("delta_pct") / 100, 4))
    found = added.agg(F.coalesce(F.sum("added"), F.lit(0.0)).alias("pressure"), F.max_by("ingredient_id", F.struct("added", -F.col("ingredient_id"))).alias("driver"), F.count(F.lit(1)).alias("n_risen"))
    return found.select(F.lit(low).cast("long").alias("n_below_target"), F.round("pressure", 2).alias("pressure"), "driver", "n_risen")
