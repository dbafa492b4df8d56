"""Reviews of prices, recipes, matches and the catalog: what a purchasing team looks through, one row for each thing to look at."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import WINDOWS, days_since, narrowest_window
from tallyforge.functions.numbers import EPSILON, half_up
from tallyforge.operators.history import since

SEVERITY_ORDER = ("critical", "high", "watch", "info", "positive")


def newest_points(rows: DataFrame, order: Sequence[str], points: int = 100) -> DataFrame:
    """The latest rows of each ingredient, numbered from the oldest of them."""
    per = Window.partitionBy("ingredient_id")
    back = F.row_number().over(per.orderBy(*[F.col(c).desc() for c in order]))
    kept = rows.withColumn("_back", back).where(F.col("_back") <= points)
    return kept.withColumn("point", F.max("_back").over(per) - F.col("_back") + 1).drop("_back")


def price_extremes(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each ingredient's cheapest and dearest purchase; of equal prices the earliest counts."""
    # The rows are moved once, by ingredient: both steps group inside what lies there.
    sound = rows.where(F.col("unit_price") > 0).select("ingredient_id", "unit_price", F.struct(F.struct(*order).alias("at"), "supplier_name").alias("first")).repartition("ingredient_id")
    prices = sound.groupBy("ingredient_id", "unit_price").agg(F.min("first").alias("first"))
    price = F.struct("unit_price", "first")
    found = prices.groupBy("ingredient_id").agg(F.min(price).alias("low"), F.max(price).alias("high"))
    return found.select(
        "ingredient_id", F.col("low.unit_price").alias("low_price"), F.col("low.first.supplier_name").alias("low_supplier"),
        F.col("high.unit_price").alias("high_price"), F.col("high.first.supplier_name").alias("high_supplier"),
    )


def deteriorated(impacts: DataFrame, limit: int = 10) -> DataFrame:
    """Recipes whose margin fell by 1.2 points or whose cost rose by 0.35; impacts: old_cost, new_cost, margin_drop."""
    drop, up = F.col("margin_drop"), F.greatest(F.col("new_cost") - F.col("old_cost"), F.lit(0.0))
    told = impacts.where(F.col("selling_price") > 0).withColumn("cost_up", up).where((drop >= 1.2) | (F.col("cost_up") >= 0.35))
    up = F.col("cost_up")
    severity = F.when((drop >= 4) | (up >= 1.2), "high").when((drop >= 2.2) | (up >= 0.55), "medium").otherwise("low")
    return told.withColumn("severity", severity).orderBy(F.desc(F.round("margin_drop", 6)), F.desc(F.round("cost_up", 6)), "recipe_id").limit(limit)


def volatile_basket(volatile: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on all volatile ingredients (ingredient_id, n_changes) and the recipes that use them; none without any."""
    users = edges.where(F.col("ingredient_id").isNotNull()).select("ingredient_id", "recipe_id")
    whole = volatile.join(users, "ingredient_id", "left").agg(
        F.countDistinct("ingredient_id").alias("n_volatile"), F.max("n_changes").alias("most_changes"), F.countDistinct("recipe_id").alias("n_recipes")
    )
    severity = F.when(F.col("most_changes") >= 10, "medium").otherwise("low")
    return whole.where(F.col("n_volatile") > 0).withColumn("severity", severity)


def supplier_intelligence(rows: DataFrame, order: Sequence[str], as_of: Column, recent: int = 12) -> DataFrame:
    """Per ingredient, over purchases of the newest one's contract: the newest price against the mean and the least of 90 days, and its steadiness."""
    per = Window.partitionBy("ingredient_id")
    newest = per.orderBy(*[F.col(c).desc() for c in order])
    anchored = rows.withColumn("_anchor", F.first("contract").over(newest)).where(F.col("contract") == F.col("_anchor"))
    numbered = anchored.withColumn("_n", F.row_number().over(newest))
    late, some = F.col("chrono") >= as_of - F.expr("INTERVAL 90 DAYS"), F.col("_n") <= recent
    price = F.col("unit_price")
    found = numbered.where(price > 0).groupBy("ingredient_id").agg(
        F.max(F.when(F.col("_n") == 1, price)).alias("latest"), F.avg(F.when(late, price)).alias("mean_90"),
        F.min(F.when(late, F.struct(price.alias("price"), "supplier_name"))).alias("low"), F.count(F.when(some, price)).alias("n_recent"),
        (F.stddev_pop(F.when(some, price)) / F.avg(F.when(some, price))).alias("cv"),
    )
    spike = F.when(F.col("latest") > F.col("mean_90") * 1.02, half_up((F.col("latest") / F.col("mean_90") - 1) * 100)).cast("long")
    gap = F.when(F.col("latest") > F.col("low.price") * 1.02, half_up((F.col("latest") / F.col("low.price") - 1) * 100)).cast("long")
    better = F.when(gap >= 2, F.col("low.supplier_name"))
    return found.select(
        "ingredient_id", "latest", "mean_90", spike.alias("spike_pct"), better.alias("better_supplier"), gap.alias("gap_pct"), F.coalesce((F.col("n_recent") >= 3) & (F.col("cv") < 0.06), F.lit(False)).alias("is_stable")
    )


def history_repairs(stored: DataFrame, lines: DataFrame) -> DataFrame:
    """Stored prices (invoice_id, ingredient_id, new_price) against what their invoice lines give: expected price, whether to repair, or why it was passed over."""
    line = lines.select("invoice_id", "ingredient_id", F.col("unit_price").alias("expected"), F.lit(True).alias("_line"))
    both = stored.join(line, ["invoice_id", "ingredient_id"], "left")
    skip = F.when(F.col("_line").isNull(), "ghost_no_invoice_line").when(F.col("expected").isNull() | (F.col("expected") <= 0), "replay_unresolved")
    both = both.withColumn("skip_reason", skip).withColumn("expected_price", F.when(F.col("skip_reason").isNull(), F.col("expected")).otherwise(F.col("new_price")))
    return both.withColumn("needs_repair", F.abs(F.col("new_price") - F.col("expected_price")) > EPSILON).drop("_line", "expected")


def synced_prices(catalog: DataFrame, latest: DataFrame) -> DataFrame:
    """Catalog entries whose price is not that of their latest matched purchase (ingredient_id, unit_price)."""
    both = catalog.join(latest.select("ingredient_id", F.col("unit_price").alias("new_price")), "ingredient_id")
    return both.where((F.col("new_price") > 0) & (F.abs(F.col("new_price") - F.coalesce("current_price", F.lit(0.0))) > EPSILON))


def recipe_link_audit(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Recipe lines whose ingredient is not an entry of the canonical catalog."""
    return edges.where(F.col("ingredient_id").isNotNull()).join(canonical.select("ingredient_id"), "ingredient_id", "left_anti")


def match_progress(matches: DataFrame) -> DataFrame:
    """Per invoice: lines by state (status), and whether all are confirmed."""
    counted = matches.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("status") == "confirmed").alias("n_matched"),
        F.count_if(F.col("status") == "suggested").alias("n_suggested"), F.count_if(F.col("status") == "unmatched").alias("n_unmatched"),
    )
    return counted.withColumn("is_complete", F.col("n_matched") == F.col("n_lines"))


def trusted(chain: DataFrame) -> DataFrame:
    """Rows of a guarded chain whose move can be shown: both prices are positive and nothing breaks the chain between them."""
    return chain.where(F.col("reason").isNull() & (F.col("unit_price") > 0) & (F.col("previous_price") > 0))


def dominant_window(rows: DataFrame, as_of: Column) -> DataFrame:
    """Per ingredient the window that holds most of its purchases of the last 180 days; of equal ones the narrowest."""
    hits = since(rows, as_of, WINDOWS[-1][0]).withColumn("window", narrowest_window(days_since(F.col("chrono"), as_of)))
    counted = hits.groupBy("ingredient_id", "window").agg(F.count(F.lit(1)).alias("n_purchases"))
    place = F.lit(0)
    for k, (_, name) in enumerate(WINDOWS):
        place = F.when(F.col("window") == name, -k).otherwise(place)
    best = counted.groupBy("ingredient_id").agg(F.max(F.struct("n_purchases", place.alias("place"), "window")).alias("b"))
    return best.select("ingredient_id", "b.window", "b.n_purchases")


def concentration_groups(tops: DataFrame, catalog: DataFrame, story: Column, least: float = 55.0) -> DataFrame:
    """Per story: recipes that one of its ingredients dominates, how many ingredients that are, and their mean share."""
    heavy = tops.where((F.col("share_pct") >= least) & (F.col("kind") == "ingredient"))
    one = heavy.groupBy(F.col("component_id").alias("ingredient_id")).agg(F.count(F.lit(1)).alias("n_recipes"), F.avg("share_pct").alias("share_pct"))
    named = one.join(catalog.withColumn("story", story).select("ingredient_id", "story"), "ingredient_id")
    return named.groupBy("story").agg(F.count(F.lit(1)).alias("n_ingredients"), F.sum("n_recipes").alias("n_recipes"), F.avg("share_pct").alias("avg_share_pct"))


def _alert(rows: DataFrame, kind: str, subject: str, severity: Column, priority: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col(subject).alias("subject_id"), severity.alias("severity"), F.round(priority, 4).cast("double").alias("priority"))


def price_alerts(moves: DataFrame, usage: DataFrame) -> DataFrame:
    """Rises and falls of the latest trusted moves (ingredient_id, unit_price, previous_price, delta_pct); usage: ingredient_id, n_recipes."""
    rows = moves.join(usage, "ingredient_id", "left").fillna({"n_recipes": 0})
    pct = F.col("delta_pct")
    up, down = rows.where(F.col("unit_price") > F.col("previous_price")), rows.where(F.col("unit_price") < F.col("previous_price"))
    severity = F.when(pct >= 15, "critical").when(pct >= 5, "high").otherwise("watch")
    rise = _alert(up, "price_increase", "ingredient_id", severity, 10_000 + pct * 100 + F.col("n_recipes"))
    return rise.unionByName(_alert(down, "price_decrease", "ingredient_id", F.lit("positive"), 3_000 + F.abs(pct)))


def margin_alerts(margins: DataFrame, target: float = 65.0, critical: float = 55.0) -> DataFrame:
    low = margins.where(F.col("margin_pct") < target)
    return _alert(low, "recipe_below_target", "recipe_id", F.when(F.col("margin_pct") < critical, "critical").otherwise("watch"), 9_000 + (target - F.col("margin_pct")) * 100)


def share_alerts(tops: DataFrame, least: float = 55.0) -> DataFrame:
    heavy = tops.where(F.col("share_pct") >= least)
    return _alert(heavy, "cost_concentration", "recipe_id", F.when(F.col("share_pct") >= 70, "watch").otherwise("info"), 5_000 + F.col("share_pct"))


def prep_alerts(prep_usage: DataFrame) -> DataFrame:
    """Preps (recipe_id, n_parents) that two or more recipes use."""
    shared = prep_usage.where(F.col("n_parents") >= 2)
    return _alert(shared, "prep_cascade", "recipe_id", F.when(F.col("n_parents") >= 3, "watch").otherwise("info"), 4_000 + F.col("n_parents") * 100)


def stale_alerts(freshness: DataFrame, usage: DataFrame, least: int = 45, limit: int = 4) -> DataFrame:
    """The ingredients in most recipes whose newest price is old or missing; freshness: ingredient_id, days."""
    old = usage.join(freshness, "ingredient_id").where(F.col("days").isNull() | (F.col("days") >= least))
    old = old.orderBy(F.desc("n_recipes"), "ingredient_id").limit(limit)
    return _alert(old, "stale_price", "ingredient_id", F.lit("info"), 1_000 + F.col("n_recipes") * 10 + F.coalesce("days", F.lit(least)))


def recent_alerts(latest: DataFrame, told: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Prices of the last days that no other price alert tells of."""
    seen = told.where(F.col("kind").isin("price_increase", "price_decrease")).select(F.col("subject_id").alias("ingredient_id"))
    fresh = since(latest, as_of, days).join(seen, "ingredient_id", "left_anti")
    return _alert(fresh, "recent_update", "ingredient_id", F.lit("info"), F.lit(500.0))


def ordered(found: Sequence[DataFrame], limit: int = 16) -> DataFrame:
    """All alerts by severity, then priority; the first ones."""
    every = reduce(DataFrame.unionByName, found)
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return every.orderBy(place, F.desc("priority"), "kind", "subject_id").limit(limit)


def menu_dependencies(usage: DataFrame, slices: DataFrame, tops: DataFrame, limit: int = 8) -> DataFrame:
    """What the menu hangs on: the four most shared ingredients, the heaviest category from a quarter on, then recipes that one line dominates."""
    shared = usage.where(F.col("n_recipes") >= 2).orderBy(F.desc("n_recipes"), "ingredient_id").limit(4)
    heaviest = slices.orderBy(F.desc("share_pct"), "category").limit(1).where(F.col("share_pct") >= 25)
    levers = tops.where(F.col("share_pct") >= 55).orderBy(F.desc(F.round("share_pct", 6)), "recipe_id").limit(limit)
    rows = [
        shared.select(F.lit(0).alias("step"), F.lit("shared_ingredient").alias("kind"), F.col("ingredient_id").cast("string").alias("subject"), F.col("n_recipes").cast("double").alias("weight")),
        heaviest.select(F.lit(1).alias("step"), F.lit("category_concentration").alias("kind"), F.col("category").alias("subject"), F.col("share_pct").alias("weight")),
        levers.select(F.lit(2).alias("step"), F.lit("recipe_margin_lever").alias("kind"), F.col("recipe_id").cast("string").alias("subject"), F.col("share_pct").alias("weight")),
    ]
    every = reduce(DataFrame.unionByName, rows)
    return every.orderBy("step", F.desc(F.round("weight", 6)), F.length("subject"), "subject").limit(limit).drop("step")
