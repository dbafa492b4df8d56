"""Products that an invoice's lines agree on: lines grouped by family and preparation, and entries made of those that the catalog lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import identity

#: Lines that must agree, where no line has a phrase of its own cluster.
LEAST_LINES = 2


def identified(rows: DataFrame, name: str = "name") -> DataFrame:
    """The rows with family, form, alias_cluster and core of the name."""
    return identity.read_once(rows, name, family="family", form="form", alias_cluster="cluster", core="core")


def clusters(lines: DataFrame) -> DataFrame:
    """invoice_id, cluster_id, canonical_name, family, form, alias_cluster, n_lines: products with two lines of an invoice, or one line in a cluster's own phrase.

    Mixed preparations and lines without one make no product; neither does cheddar on an invoice that has it in several preparations, or in one and without. lines: invoice_id, name.
    Lines are counted before they meet, so an invoice of any length leaves a row for each family and preparation.
    """
    told = identified(lines).where(F.col("family").isNotNull())
    groups = told.groupBy("invoice_id", "family", "form").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("alias_cluster").alias("alias_cluster"), F.max("alias_cluster").alias("_last")
    )
    cheddar = F.when(F.col("family") == "cheddar", F.coalesce("form", F.lit("")))
    whole = Window.partitionBy("invoice_id")
    groups = groups.withColumns({"_least": F.min(cheddar).over(whole), "_most": F.max(cheddar).over(whole)})
    clear = (F.col("alias_cluster").isNull() | (F.col("alias_cluster") == F.col("_last"))) & ((F.col("family") != "cheddar") | (F.col("_least") == F.col("_most")))
    strong = F.col("alias_cluster").isNotNull() & (F.col("alias_cluster") != identity.PLAIN_CHEDDAR)
    kept = groups.where(F.col("form").isNotNull() & ~F.contains("form", F.lit("+")) & clear & ((F.col("n_lines") >= LEAST_LINES) | strong))
    return kept.select(
        "invoice_id", F.coalesce("alias_cluster", F.concat_ws("-", "family", "form")).alias("cluster_id"), F.upper(F.concat_ws(" ", "family", F.translate("form", "_", " "))).alias("canonical_name"),
        "family", "form", "alias_cluster", "n_lines",
    )


def synthesised(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """cluster_id, canonical_name, family, form, n_invoices, n_lines: products of the invoices whose family and preparation no entry has. catalog: a column name."""
    every = found.groupBy("cluster_id", "canonical_name", "family", "form").agg(F.count(F.lit(1)).alias("n_invoices"), F.sum("n_lines").alias("n_lines"))
    covered = identified(catalog.select("name")).where(F.col("family").isNotNull() & F.col("form").isNotNull()).select("family", "form").distinct()
    return every.join(covered, ["family", "form"], "left_anti")
