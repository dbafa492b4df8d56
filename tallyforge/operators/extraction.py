"""Repairs of amounts that were read from invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """To whole cents, halves up."""
    return F.floor(F.round(x * 100, 6) + 0.5) / 100


def bound_amounts(lines: DataFrame) -> DataFrame:
    """unit_price and total from the printed columns gross_unit_price, discount_pct and line_total_net, which win over what was read as price and total.

    The net price is the gross price less the discount. A single piece whose net total says otherwise costs its total; any other line keeps the derived
    price. Without columns a price that is really the discount's number is total over quantity.
    """
    gross, off, net, n = F.col("gross_unit_price"), F.col("discount_pct"), F.col("line_total_net"), F.col("quantity")
    derived = F.when(gross.isNotNull() & off.isNotNull(), cents(gross * (1 - off / 100))).otherwise(gross)
    apart = F.abs(cents(n * gross * (1 - off / 100)) - net) > 0.05
    price = F.coalesce(derived, F.col("unit_price"))
    price = F.when((n == 1) & apart, cents(net)).otherwise(price)
    total = F.coalesce(net, F.col("total"))
    mistaken = gross.isNull() & off.isNotNull() & (F.abs(F.col("unit_price") - off) < 0.01) & (n > 0) & total.isNotNull()
    return lines.withColumns({"unit_price": F.when(mistaken, cents(total / n)).otherwise(price), "total": total})


def repaired_to_subtotal(lines: DataFrame, slips: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """lines: invoice_id, quantity, unit_price, total, net_subtotal. Where the lines miss the subtotal by a typical slip and exactly one single-piece
    line below ten can make it up within 12 %, that line is raised."""
    per = Window.partitionBy("invoice_id")
    price, total = F.col("unit_price"), F.col("total")
    gap = cents(F.col("net_subtotal") - cents(F.sum(F.coalesce(total, F.lit(0.0))).over(per)))
    rows = lines.withColumn("_gap", gap)
    slip = F.lit(False)
    for s in slips:
        slip = slip | (F.abs(F.col("_gap") - s) < 0.01)
    new = cents(price + F.col("_gap"))
    fits = slip & (F.col("quantity") == 1) & (F.abs(price - total) < 0.01) & (price < 10) & (new > 0) & (F.abs(new - price) / price <= 0.12)
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_new", new)
    lone = F.col("_fits") & (F.sum(F.col("_fits").cast("int")).over(per) == 1)
    rows = rows.withColumn("was_repaired", lone)
    return rows.withColumns({"unit_price": F.when(lone, F.col("_new")).otherwise(price), "total": F.when(lone, F.col("_new")).otherwise(total)}).drop("_gap", "_fits", "_new")


def footer_check(footers: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """confidence: high where net and tax make the total, low where they don't, null where one is missing."""
    gap = F.abs(cents(F.col("net_subtotal") + F.col("vat")) - F.col("total"))
    return footers.withColumn("confidence", F.when(gap.isNull(), None).when(gap <= tolerance + 1e-9, "high").otherwise("low"))


def anchored_quantities(lines: DataFrame) -> DataFrame:
    """lines: quantity, ocr_quantity, unit, unit_price, line_total_net, discount_pct. Adds anchored and mismatch; an anchored line takes the quantity of the scan.

    Only discounted lines by the kilo whose scanned quantity is a fraction are in question. Where the two differ by more than 2 %, the scanned one
    is taken if it makes the net total better by ten cents, or if the other fails arithmetic and it does not miss by more than fifty.
    """
    scan, read, total = F.col("ocr_quantity"), F.col("quantity"), F.col("line_total_net")
    in_scope = (F.lower("unit") == "kg") & F.col("discount_pct").isNotNull() & (F.abs(scan - F.round(scan)) > 1e-9)
    apart = cents(F.abs(scan - read) / F.greatest(scan, F.lit(0.01)) * 100)

    def miss(quantity: Column) -> Column:
        return cents(F.abs(total - quantity * F.col("unit_price")))

    expected = cents(read * F.col("unit_price"))
    gap = cents(F.abs(expected - cents(total)))
    fails = (gap > 0.5) & (cents(gap / F.greatest(F.abs(cents(total)), F.abs(expected), F.lit(0.01)) * 100) > 5)
    better = (miss(scan) < miss(read) - 0.1) | (fails & (miss(scan) <= 0.5))
    anchored = F.coalesce(in_scope & (apart > 2) & total.isNotNull() & better, F.lit(False))
    mismatch = F.coalesce(in_scope & (apart > 10), F.lit(False)) & ~anchored
    return lines.withColumns({"anchored": anchored, "mismatch": mismatch, "quantity": F.when(anchored, scan).otherwise(read)})
