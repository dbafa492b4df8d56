"""The price chain kept up to date by a stream of price events.

Events may come late or out of order, so nothing is dropped by a watermark: each micro-batch relinks the whole chain of every ingredient
it touches, from the log and the batch, and writes these chains as the batch's own folder. A key's chain is that of its newest batch. A
batch that is run again after a failure writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import pct_change

ORDER = ("chrono", "event_id")


def chained(events: DataFrame) -> DataFrame:
    """Every event with the price before it and the change."""
    before = F.lag("unit_price").over(Window.partitionBy("ingredient_id").orderBy(*ORDER))
    rows = events.withColumn("previous_price", before)
    return rows.withColumn("delta", F.col("unit_price") - F.col("previous_price")).withColumn("delta_pct", pct_change(F.col("previous_price"), F.col("unit_price")))


class PriceChainSink:
    """foreachBatch target; log and chains are folders that all executors share."""

    def __init__(self, log: str, chains: str):
        self.log, self.chains = log, chains

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.log}/batch={batch_id}")
        whole = spark.read.parquet(self.log).where(F.col("batch") <= batch_id).drop("batch")
        touched = spark.read.parquet(f"{self.log}/batch={batch_id}").select("ingredient_id").distinct()
        whole = whole.join(touched, "ingredient_id", "left_semi").dropDuplicates(["event_id"])
        chained(whole).write.mode("overwrite").parquet(f"{self.chains}/batch={batch_id}")


def current_chains(spark: SparkSession, chains: str) -> DataFrame:
    """The newest chain of every ingredient."""
    rows = spark.read.parquet(chains)
    newest = rows.groupBy("ingredient_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["ingredient_id", "batch"]).drop("batch")


def run_available(events: DataFrame, folder: str) -> DataFrame:
    """Runs a streaming frame of price events to the end of what is there and returns the chains."""
    sink = PriceChainSink(f"{folder}/log", f"{folder}/chains")
    query = events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return current_chains(events.sparkSession, sink.chains)
