"""Merging catalog entries: which entry each one becomes, over chains of merges, and every table that refers to them rewritten.

Merges are links; entries linked over any path are one. Of these the entry with most references stays, then that of the least id. A rewrite is a join with the id map: it
changes no row whose id is no source, so running it twice changes nothing the second time. `rewritten_once` writes a run's tables behind a marker: a run that
is repeated, after a lost driver or by mistake, reads what stands there, and writes again only tables that were not finished.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.views import saved


def components(links: DataFrame) -> DataFrame:
    """id, root: every id of rows (a, b) with the least id that it is linked with over any path.

    Labels fall to the least neighbour's and then jump to their label's label, so long chains take rounds by their logarithm; each round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    both = saved(both, "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        # a root that learns of a lower one takes all that point to it along
        pulled = lower.groupBy("root").agg(F.min("low").alias("pulled")).toDF("old", "pulled")
        jumped = lower.join(pulled, F.col("low") == F.col("old"), "left").join(pulled.toDF("old2", "pulled2"), F.col("root") == F.col("old2"), "left")
        after = saved(jumped.select("id", F.col("root").alias("before"), F.least("low", F.coalesce("pulled", "low"), F.coalesce("pulled2", "low")).alias("root")), "labels")
        labels = after.select("id", "root")
        if after.where(F.col("before") != F.col("root")).isEmpty():
            return labels


def id_map(links: DataFrame, references: DataFrame) -> DataFrame:
    """source_id, target_id of every entry that becomes another one. links: a, b; references: ingredient_id, references; an entry without a row there has none."""
    found = components(links).join(references.select(F.col("ingredient_id").alias("id"), "references"), "id", "left").fillna({"references": 0})
    stays = found.groupBy("root").agg(F.max_by("id", F.struct("references", -F.col("id"))).alias("target_id"))
    return found.join(stays, "root").where(F.col("id") != F.col("target_id")).select(F.col("id").alias("source_id"), "target_id")


def rewritten(rows: DataFrame, ids: DataFrame, column: str = "ingredient_id") -> DataFrame:
    """The rows with the ids that they now have, and was_rewritten; other columns stay."""
    return rows.join(ids.withColumnsRenamed({"source_id": "_source", "target_id": "_target"}), rows[column] == F.col("_source"), "left").withColumns(
        {"was_rewritten": F.col("_source").isNotNull(), column: F.coalesce("_target", column)}
    ).drop("_source", "_target")


def merged_catalog(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalog with merged_into_ingredient_id and is_archived."""
    marked = catalog.join(ids.withColumnsRenamed({"source_id": "ingredient_id", "target_id": "merged_into_ingredient_id"}), "ingredient_id", "left")
    return marked.withColumn("is_archived", F.col("merged_into_ingredient_id").isNotNull())


def rewritten_once(spark: SparkSession, tables: Mapping[str, DataFrame], ids: DataFrame, folder: str, run: str) -> dict[str, DataFrame]:
    """Every table rewritten below folder/run; what a run of this name has finished is read, not written again."""
    out = {}
    for name, rows in tables.items():
        path = f"{folder}/{run}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rewritten(rows, ids).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out
