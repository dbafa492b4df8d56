"""Price chains kept up to date by a stream of purchases that come late, come again, are corrected and are taken back.

Events are puts (a purchase of a document) and deletes (of a whole document). Each has a sequence number; of the puts of one event the largest counts, and a delete hides those
of its document with smaller ones, whichever came first. So any order of arrival, and any cut into micro-batches, gives the same chains.

The state is two tables in buckets: chains by ingredient and an index of documents. A batch reads and writes only the buckets that its events, or the documents they delete,
touch, and links anew only the touched ingredients; a manifest of one row a bucket says which version of each is current. A batch that runs again after a failure starts from
the manifest before it and writes its own versions again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.streaming.price_chain import chained

def _schema(**fields: str) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


_PUT = {"ingredient_id": "long", "supplier_name": "string", "chrono": "timestamp", "event_id": "long", "document_id": "long", "unit_price": "double", "seq": "long"}
EVENT = _schema(op="string", **_PUT)
CHAIN = _schema(**_PUT, deleted_seq="long", previous_price="double", delta="double", delta_pct="double", bucket="integer")
INDEX = _schema(document_id="long", ingredient_id="long", deleted_seq="long", bucket="integer")
MANIFEST = _schema(store="string", bucket="integer", version="long")


@dataclass(frozen=True)
class ChainStore:
    """foreachBatch target below a folder that all executors share. buckets: of each table; the driver sees as many rows of the manifest."""

    folder: str
    buckets: int = 64

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession, before: int) -> dict[tuple[str, int], int]:
        """The current version of every bucket before a batch."""
        if before == 0:
            return {}
        rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{before - 1}").collect()  # 2 * buckets rows at most
        return {(r["store"], r["bucket"]): r["version"] for r in rows}

    def _read(self, spark: SparkSession, store: str, schema: StructType, current: dict, touched: list[int] | None) -> DataFrame:
        wanted = [(b, v) for (s, b), v in sorted(current.items()) if s == store and (touched is None or b in touched)]
        if not wanted:
            return spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{store}/version={v}/bucket={b}" for b, v in wanted]
        inside = StructType([f for f in schema if f.name != "bucket"])
        key = "ingredient_id" if store == "chains" else "document_id"
        return spark.read.schema(inside).parquet(*paths).withColumn("bucket", self._bucket(key))

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # buckets rows at most

    def _write(self, rows: DataFrame, store: str, batch_id: int) -> None:
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/{store}/version={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = self._manifest(spark, batch_id)
        batch = batch.persist()
        puts = batch.where(F.col("op") == "put").drop("op").groupBy("event_id", "document_id").agg(F.max_by(F.struct("ingredient_id", "supplier_name", "chrono", "unit_price", "seq"), "seq").alias("p")).select("event_id", "document_id", "p.*")
        deletes = batch.where(F.col("op") == "delete").groupBy("document_id").agg(F.max("seq").alias("deleted_seq"))

        named = batch.select("document_id", F.when(F.col("op") == "put", F.col("ingredient_id")).alias("ingredient_id"), F.when(F.col("op") == "delete", F.col("seq")).alias("deleted_seq")).withColumn("bucket", self._bucket("document_id"))
        documents = self._touched(named)
        index = self._read(spark, "index", INDEX, current, documents).unionByName(named).groupBy("document_id", "ingredient_id", "bucket").agg(F.max("deleted_seq").alias("deleted_seq")).persist()
        self._write(index.select([f.name for f in INDEX]), "index", batch_id)

        gone = index.groupBy("document_id").agg(F.max("deleted_seq").alias("deleted_seq")).where(F.col("deleted_seq").isNotNull())
        held = index.join(deletes.select("document_id"), "document_id", "left_semi").where(F.col("ingredient_id").isNotNull()).select("ingredient_id")
        touched = puts.select("ingredient_id").unionByName(held).distinct().withColumn("bucket", self._bucket("ingredient_id")).persist()
        chains = self._touched(touched)
        if chains:
            old = self._read(spark, "chains", CHAIN, current, chains)
            kept = old.join(touched.select("ingredient_id"), "ingredient_id", "left_anti")
            base = old.join(touched.select("ingredient_id"), "ingredient_id", "left_semi").drop("previous_price", "delta", "delta_pct", "bucket", "deleted_seq")
            names = base.columns
            newest = base.unionByName(puts.select(*names)).groupBy("event_id").agg(F.max_by(F.struct(*names), "seq").alias("p")).select("p.*")
            marked = newest.join(gone, "document_id", "left")
            alive = F.col("deleted_seq").isNull() | (F.col("deleted_seq") < F.col("seq"))
            none = [F.lit(None).cast("double").alias(c) for c in ("previous_price", "delta", "delta_pct")]
            linked = chained(marked.where(alive)).unionByName(marked.where(~alive).select("*", *none)).withColumn("bucket", self._bucket("ingredient_id"))
            fields = [f.name for f in CHAIN]
            self._write(linked.select(fields).unionByName(kept.select(fields)), "chains", batch_id)
        new = current | {("index", b): batch_id for b in documents} | {("chains", b): batch_id for b in chains}
        spark.createDataFrame([(s, b, v) for (s, b), v in sorted(new.items())], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{batch_id}")
        for frame in (batch, index, touched):
            frame.unpersist()

    def chains(self, spark: SparkSession, batches: int) -> DataFrame:
        """The purchases that hold after so many batches, linked."""
        rows = self._read(spark, "chains", CHAIN, self._manifest(spark, batches), None)
        return rows.where(F.col("deleted_seq").isNull() | (F.col("deleted_seq") < F.col("seq"))).drop("deleted_seq", "bucket", "seq")


def run_available(events: DataFrame, store: ChainStore) -> DataFrame:
    """Runs a streaming frame of events to the end of what is there and returns the chains."""
    query = events.writeStream.foreachBatch(store).option("checkpointLocation", f"{store.folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    ends = [p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0]
    return store.chains(events.sparkSession, max(ends) + 1 if ends else 0)
