"""Invoice figures: months, suppliers, freshness, line checks and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import days_since, freshness


def month_kpis(lines: DataFrame) -> DataFrame:
    """Spend, invoices and top supplier of each month, and the change to the calendar month before, if that has invoices."""
    month = F.trunc("chrono", "month")
    per_supplier = lines.groupBy(month.alias("month"), "supplier_name").agg(F.sum("total").alias("spend"))
    best = per_supplier.groupBy("month").agg(
        F.sum("spend").alias("spend"), F.max_by("supplier_name", F.struct(F.round("spend", 4), "supplier_name")).alias("top_supplier")
    )
    counts = lines.groupBy(month.alias("month")).agg(F.countDistinct("invoice_id").alias("n_invoices"), F.count(F.lit(1)).alias("n_lines"))
    months = best.join(counts, "month")
    before = months.select(F.add_months("month", 1).alias("month"), F.col("spend").alias("previous_spend"))
    out = months.join(before, "month", "left")
    return out.withColumn("mom_pct", F.when(F.col("previous_spend") > 0, (F.col("spend") / F.col("previous_spend") - 1) * 100))


def supplier_ranks_by_month(lines: DataFrame, most: int = 3) -> DataFrame:
    """The suppliers with the largest spend of each month."""
    spend = lines.groupBy(F.trunc("chrono", "month").alias("month"), "supplier_name").agg(F.round(F.sum("total"), 4).alias("spend"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("spend"), "supplier_name"))
    return spend.withColumn("rank", rank).where(F.col("rank") <= most)


def pricing_freshness(catalog: DataFrame, lines: DataFrame, as_of: Column) -> DataFrame:
    """Days since each catalog entry's last purchase, and how fresh that makes its price."""
    last = lines.groupBy("ingredient_id").agg(F.max("chrono").alias("last_purchase"))
    days = days_since(F.col("last_purchase"), as_of)
    return catalog.select("ingredient_id").join(last, "ingredient_id", "left").withColumn("days", F.when(F.col("last_purchase").isNotNull(), days)).withColumn("level", freshness(F.col("days")))


def reconciled(lines: DataFrame, expected: Column, stated: Column) -> DataFrame:
    """Adds variance and variance_pct between what a line should come to and what it states, and both gates' verdicts."""
    gap = F.abs(expected - stated)
    pct = F.when(F.abs(expected) > 1e-6, gap / F.abs(expected) * 100)
    return (
        lines.withColumn("variance", gap).withColumn("variance_pct", pct)
        .withColumn("fails_any", (F.col("variance") > 0.5) | F.coalesce(F.col("variance_pct") > 5, F.lit(False)))
        .withColumn("fails_both", (F.col("variance") > 0.5) & F.coalesce(F.col("variance_pct") > 5, F.lit(False)))
    )


def filled_amounts(lines: DataFrame) -> DataFrame:
    """A missing unit price is total over quantity; a missing total is quantity times price."""
    price, total, quantity = F.col("unit_price"), F.col("total"), F.col("quantity")
    new_price = F.coalesce(price, F.when(quantity > 0, total / quantity))
    new_total = F.coalesce(total, quantity * price)
    return lines.withColumns({"unit_price": new_price, "total": new_total, "was_filled": (price.isNull() & new_price.isNotNull()) | (total.isNull() & new_total.isNotNull())})


def findings(lines: DataFrame) -> DataFrame:
    """A row per line and failed check: missing quantity, missing amount, arithmetic."""
    checks = F.array_compact(F.array(
        F.when(F.col("quantity").isNull() | (F.col("quantity") <= 0), F.lit("missing_quantity")),
        F.when(F.col("unit_price").isNull() & F.col("total").isNull(), F.lit("missing_amount")),
        F.when(F.col("fails_any"), F.lit("mathematics")),
        F.when(F.col("fails_both"), F.lit("extraction_mathematics")),
    ))
    return lines.withColumn("finding", F.explode(checks))
