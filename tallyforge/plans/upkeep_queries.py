"""The upkeep queries over the derived views, each with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import units
from tallyforge.operators import upkeep
from tallyforge.plans.oracles import KITCHEN, LINES, T
from tallyforge.plans.queries import _costs, _kitchen, r4
from tallyforge.sources import texts, views
from tallyforge.sources.views import PURCHASE_ORDER, table
from tallyforge.streaming import chain_store


def invoice_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains after every fiftieth order was deleted."""
    deleted = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 50 == 0).select(F.col("o_orderkey").alias("invoice_id"))
    rows = upkeep.relinked_after_delete(views.purchase_lines(spark, sf_dir), deleted, PURCHASE_ORDER)
    return rows.select("ingredient_id", "invoice_id", "line_number", "supplier_id", "unit_price", "previous_price")


def price_unchanged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that cost what the ingredient's purchase before cost, packs and amounts in round figures."""
    rows = views.purchase_lines(spark, sf_dir).withColumn("pack", F.floor(F.col("total") / 10000).cast("double")).withColumn("amount", F.floor(F.col("quantity") / 10).cast("double"))
    before = Window.partitionBy("ingredient_id").orderBy(*PURCHASE_ORDER)
    rows = rows.withColumn("old_pack", F.lag("pack").over(before)).withColumn("old_amount", F.lag("amount").over(before))
    same = upkeep.prices_unchanged(F.col("old_pack"), F.col("old_amount"), F.col("pack"), F.col("amount"))
    return rows.where(same).select("ingredient_id", "invoice_id", "line_number", "supplier_id", "pack", "amount", "old_pack", "old_amount")


def implausible_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured part whose pack can't be right as a volume."""
    millilitres = F.when(units.base_unit(F.col("unit")) == "ml", units.base_quantity(F.col("quantity"), F.col("unit")))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("price"))
    rows = texts.measures(spark, sf_dir).withColumn("millilitres", millilitres).join(prices, "id")
    return rows.where(upkeep.implausible_volume(F.col("price"), F.col("millilitres"))).select("id", "millilitres")


def signal_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals: their ids say the severity, each thirteenth names no ingredient."""
    severity = F.element_at(F.array(*map(F.lit, (*upkeep.SEVERITIES, "positive"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("signal_id"), F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("ingredient_id"), severity.alias("severity"), F.col("value").alias("priority")
    )
    return upkeep.deduped_signals(rows)


def prep_servings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servings of each prep's batch and what one costs; each ninth prep has no serving size."""
    edges, made, catalog = _kitchen(spark, sf_dir)
    serving = F.when(F.col("recipe_id") % 9 != 0, (1 + F.col("recipe_id") % 4) * 0.5)
    rows = made.where(F.col("type") == "prep").withColumn("servings", upkeep.servings(F.col("output_quantity"), serving)).join(_costs(edges, made, catalog), "recipe_id", "left")
    return rows.withColumn("cost_per_serving", F.col("total_cost") / F.col("servings")).select("recipe_id", "servings", *r4("cost_per_serving"))


def streaming_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains after documents came late, twice, corrected and deleted, in several micro-batches: as many however long the log is, with files and buckets that grow in number, not in size."""
    folder = views.shared_folder(spark, "arrivals")
    rows = texts.arrivals(spark, sf_dir)
    n = table(spark, sf_dir, "events").count()
    files, buckets = 1 + n // 400_000, 8 + n // 100_000
    for k in range(texts.ARRIVALS):
        rows.where(F.col("arrival") == k).drop("arrival").repartition(files, "document_id").write.mode("append").parquet(f"{folder}/log")
    events = spark.readStream.schema(chain_store.EVENT).option("maxFilesPerTrigger", files).parquet(f"{folder}/log")
    store = chain_store.ChainStore(views.shared_folder(spark, "chain-store"), buckets=buckets)
    found = chain_store.run_available(events, store)
    return found.select("ingredient_id", "event_id", "document_id", "unit_price", "previous_price", "delta", "delta_pct")


ORACLE_SQL: dict[str, str] = {
    "streaming_upkeep": """
        WITH a AS (SELECT user_id AS ingredient_id, event_id, event_id // 3 AS document_id, ts, event_id % 3 = 0 AND event_id // 3 % 26 = 0 AS again, value FROM events),
        k AS (SELECT *, CASE WHEN again THEN value * 1.2::DOUBLE WHEN event_id % 17 = 0 THEN value * 1.1::DOUBLE ELSE value END AS unit_price FROM a WHERE document_id % 13 <> 0 OR again),
        l AS (SELECT *, lag(unit_price) OVER (PARTITION BY ingredient_id ORDER BY ts, event_id) AS previous_price FROM k)
        SELECT ingredient_id, event_id, document_id, unit_price, previous_price, unit_price - previous_price AS delta,
               CASE WHEN abs(previous_price) > 1e-6 THEN (unit_price - previous_price) / previous_price * 100 END AS delta_pct FROM l""",
    "invoice_retraction": f"""
        WITH {LINES}, hit AS (SELECT DISTINCT ingredient_id FROM pl WHERE invoice_id % 50 = 0)
        SELECT ingredient_id, invoice_id, line_number, supplier_id, unit_price, lag(unit_price) OVER (PARTITION BY ingredient_id ORDER BY {T}) AS previous_price
        FROM pl WHERE invoice_id % 50 <> 0 AND ingredient_id IN (SELECT ingredient_id FROM hit)""",
    "price_unchanged_lines": f"""
        WITH {LINES}, r AS (SELECT *, floor(total / 10000) AS pack, floor(quantity / 10) AS amount FROM pl),
        b AS (SELECT *, lag(pack) OVER w AS old_pack, lag(amount) OVER w AS old_amount FROM r WINDOW w AS (PARTITION BY ingredient_id ORDER BY {T}))
        SELECT ingredient_id, invoice_id, line_number, supplier_id, pack, amount, old_pack, old_amount FROM b
        WHERE CASE WHEN pack > 0 AND amount > 0 AND old_pack > 0 AND old_amount > 0 THEN abs(old_pack / old_amount - pack / amount) <= 1e-6 ELSE old_pack IS NOT NULL AND abs(old_pack - pack) <= 1e-6 END""",
    "implausible_volumes": f"""
        WITH u AS (SELECT p_partkey AS id, p_retailprice / 100 AS price, p_size / 8 AS q, lower(trim({texts.UNIT_SQL})) AS unit FROM part),
        m AS (SELECT id, price, q * CASE unit WHEN 'l' THEN 1000 WHEN 'cl' THEN 10 WHEN 'ml' THEN 1 END AS millilitres FROM u)
        SELECT id, millilitres FROM m WHERE millilitres > 0 AND (price / millilitres * 1000 > 50 OR millilitres < 50)""",
    "signal_dedupe": """
        WITH s AS (SELECT event_id AS signal_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS ingredient_id, event_id % 4 AS k,
                          CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS severity, value AS priority FROM events WHERE event_id % 4 < 3)
        SELECT signal_id, ingredient_id, severity, priority FROM s
        QUALIFY row_number() OVER (PARTITION BY ingredient_id, CASE WHEN ingredient_id IS NULL THEN signal_id END ORDER BY k, priority DESC, signal_id) = 1""",
    "prep_servings": f"""
        WITH RECURSIVE {KITCHEN}, p AS (SELECT r.recipe_id, total_cost, CASE WHEN output_quantity > 0 AND r.recipe_id % 9 <> 0 THEN output_quantity / ((1 + r.recipe_id % 4) * 0.5::DOUBLE) END AS servings
                                        FROM rec r LEFT JOIN cost c ON c.recipe_id = r.recipe_id WHERE r.type = 'prep')
        SELECT recipe_id, servings, round(total_cost / servings, 4) AS cost_per_serving FROM p""",
}
