"""The nine tables of the domain, their loaders and their sinks.

Scans are plain parquet reads: column selection and filters reach the files. Sinks are idempotent: they write the whole new state of
what they own, so that a repeated or restarted run leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in text.split(", "))])


SCHEMAS: dict[str, T.StructType] = {
    "ingredients": _schema(
        "id string, user_id string, name string, normalized_name string, canonical_name string, unit string, base_unit string, current_price double, "
        "purchase_quantity double, purchase_unit string, supplier string, density_g_per_ml double, ingredient_kind string, is_archived boolean, "
        "merged_into_ingredient_id string, archived_at timestamp, created_at timestamp"
    ),
    "invoices": _schema("id string, user_id string, supplier_name string, invoice_date date, total double, settlement_status string, created_at timestamp"),
    "invoice_items": _schema("id string, invoice_id string, user_id string, name string, quantity double, unit string, unit_price double, total double"),
    "recipes": _schema("id string, user_id string, name string, category string, selling_price double, type string, output_quantity double, output_unit string"),
    "recipe_ingredients": _schema("id string, recipe_id string, ingredient_id string, sub_recipe_id string, quantity double, unit string"),
    "ingredient_price_history": _schema(
        "id string, ingredient_id string, invoice_id string, ingredient_name string, supplier_name string, ingredient_unit string, "
        "previous_price double, new_price double, delta double, delta_percent double, created_at timestamp"
    ),
    "recipe_margin_impacts": _schema(
        "recipe_id string, ingredient_id string, old_recipe_cost double, new_recipe_cost double, old_margin_pct double, new_margin_pct double, "
        "margin_delta_pct double, estimated_monthly_loss double, impact_level string, created_at timestamp"
    ),
    "ingredient_aliases": _schema(
        "id string, ingredient_id string, alias_name string, normalized_alias string, supplier_name string, confidence double, confirmed_by_user boolean, created_at timestamp"
    ),
    "invoice_item_matches": _schema(
        "invoice_item_id string, user_id string, invoice_id string, ingredient_id string, status string, match_kind string, confirmed_at timestamp, "
        "corrected_at timestamp, previous_ingredient_id string"
    ),
}
MATCH_STATES = ("unmatched", "suggested", "confirmed")


def load(spark: SparkSession, folder: str, name: str, user_id: str | None = None) -> DataFrame:
    """A table by name; columns that the files lack come as nulls. user_id keeps one tenant's rows."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    have = set(rows.columns)
    out = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
    return out.where(F.col("user_id") == user_id) if user_id is not None and "user_id" in out.columns else out


def filled(column: str) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def is_archived() -> Column:
    """Archived, or merged into another entry."""
    return F.coalesce(F.col("is_archived"), F.lit(False)) | filled("merged_into_ingredient_id")


def active_catalog(ingredients: DataFrame) -> DataFrame:
    return ingredients.where(~is_archived())


def archived_catalog(ingredients: DataFrame) -> DataFrame:
    reason = F.when(filled("merged_into_ingredient_id"), "merged").otherwise("archived")
    return ingredients.where(is_archived()).withColumn("archive_reason", reason)


def canonical_catalog(ingredients: DataFrame) -> DataFrame:
    """Active entries of the canonical kind; an entry without a kind is canonical."""
    return active_catalog(ingredients).where(F.coalesce(F.col("ingredient_kind"), F.lit("canonical")) == "canonical")


def alias_key(alias: Column, supplier: Column) -> Column:
    """supplier::alias, or the alias alone where there is no supplier."""
    return F.when(F.coalesce(F.trim(supplier) != "", F.lit(False)), F.concat_ws("::", supplier, alias)).otherwise(alias)


def confirmed_alias_map(aliases: DataFrame) -> DataFrame:
    """lookup_key, ingredient_id of the confirmed aliases; of several with one key the newest holds, then the largest id."""
    sound = aliases.where(F.col("confirmed_by_user") & filled("normalized_alias"))
    keyed = sound.withColumn("lookup_key", alias_key(F.col("normalized_alias"), F.col("supplier_name")))
    return keyed.groupBy("lookup_key").agg(F.max_by("ingredient_id", F.struct("created_at", "id")).alias("ingredient_id"))


def newest(rows: DataFrame, by: str, tie: str, limit: int | None = None) -> DataFrame:
    """Newest first; a limit is the caller's."""
    ordered = rows.orderBy(F.col(by).desc_nulls_last(), F.col(tie))
    return ordered if limit is None else ordered.limit(limit)


def price_trend(history: DataFrame, ingredient_id: str, points: int = 100) -> DataFrame:
    """The latest rows of one ingredient, oldest first."""
    mine = history.where(F.col("ingredient_id") == ingredient_id)
    return newest(mine, "created_at", "id", points).orderBy("created_at", "id")


def upserted(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The state after the changes: of each key's changes the latest replaces the row."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    new = changes.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") == 1).drop("_n").select(*state.columns)
    return state.join(new.select(key), key, "left_anti").select(*state.columns).unionByName(new)


def valid_match_states(matches: DataFrame) -> DataFrame:
    """Rows whose status agrees with their ingredient and confirmation time."""
    status, has = F.col("status"), F.col("ingredient_id").isNotNull()
    return matches.where(
        status.isin(*MATCH_STATES)
        & ((status == "unmatched") == ~has)
        & ((status == "confirmed") == F.col("confirmed_at").isNotNull())
    )
