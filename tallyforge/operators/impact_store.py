"""What price changes did to margins, recorded once a run and read back newest first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.numbers import impact_band
from tallyforge.operators.recipes import priced_lines


def direct_impacts(edges: DataFrame, recipes: DataFrame, catalog: DataFrame, pct: Column) -> DataFrame:
    """recipe_id, ingredient_id, cost_up, margin_drop, impact of every dish and direct ingredient whose price moves by pct, a column over ingredient_id; null moves nothing."""
    moved = priced_lines(edges, catalog).withColumn("pct", pct).where(F.col("pct").isNotNull() & F.col("line_cost").isNotNull())
    dishes = recipes.where((F.col("type") == "dish") & (F.col("selling_price") > 0)).select("recipe_id", "selling_price")
    rows = moved.join(dishes, "recipe_id").withColumn("cost_up", F.col("line_cost") * F.col("pct") / 100).withColumn("margin_drop", F.col("cost_up") / F.col("selling_price") * 100)
    return rows.select("recipe_id", "ingredient_id", "cost_up", "margin_drop", impact_band(F.col("margin_drop")).alias("impact"))


@dataclass(frozen=True)
class ImpactStore:
    """A folder that all executors share, one subfolder a run. A run counts once it is whole: one that was cut off is written anew, one that stands is left as it is."""

    folder: str

    def record(self, impacts: DataFrame, run: int) -> bool:
        """Writes the impacts of a run, one row per recipe and ingredient (the largest drop of several); false if the run stands already."""
        spark, path = impacts.sparkSession, f"{self.folder}/run={run}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return False
        best = F.max_by(F.struct("cost_up", "margin_drop", "impact"), F.struct("margin_drop", "cost_up"))
        impacts.groupBy("recipe_id", "ingredient_id").agg(best.alias("i")).select("recipe_id", "ingredient_id", "i.*").write.mode("overwrite").parquet(path)
        return True

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.folder).parquet(f"{self.folder}/run=*")

    def newest(self, spark: SparkSession) -> DataFrame:
        """The newest run's impact of each recipe and ingredient: a combining aggregate, however many runs there are."""
        names = ["run", "cost_up", "margin_drop", "impact"]
        return self.history(spark).groupBy("recipe_id", "ingredient_id").agg(F.max_by(F.struct(*names), "run").alias("i")).select("recipe_id", "ingredient_id", "i.*")
