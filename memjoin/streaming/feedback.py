"""Field extraction as a Structured Streaming job.

Its state lives in versioned Parquet folders under a shared path. Every micro-batch reads the newest complete version, writes
the next one and only then moves on, so a replayed batch id finds its version already written and is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.operators import fields as P


class VersionedTable:
    """Parquet versions `v=<batch>` under one folder; a version counts once its number stands in the manifest beside them."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path, self.ddl = spark, path, ddl
        spark.createDataFrame([], "version bigint").write.mode("append").parquet(f"{path}/manifest")

    def versions(self) -> list[int]:
        return sorted(r.version for r in self.spark.read.schema("version bigint").parquet(f"{self.path}/manifest").distinct().collect())

    def read(self, before: int | None = None) -> DataFrame:
        held = [v for v in self.versions() if before is None or v < before]
        if not held:
            return self.spark.createDataFrame([], self.ddl)
        return self.spark.read.schema(self.ddl).parquet(f"{self.path}/v={held[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self.spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


VALUES_DDL = "field string, value string"


def extraction_stream(items: DataFrame, registry: VersionedTable, values: VersionedTable, seed: DataFrame, output: str, checkpoint: str):
    """Extract fields from arriving texts (item, text), append the predictions and add their counts to the registry.

    `values` keeps the (field, value) table beside the registry, so that different values add up over the batches.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id in registry.versions():
            return
        rows = P.stable_predictions(P.extract(batch, "item"))
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        held = registry.read(batch_id)
        known = held if registry.versions() else seed
        written = batch.sparkSession.read.parquet(f"{output}/batch={batch_id}")
        found, counted = P.resolved(written, known), values.read(batch_id)
        values.write(P.field_values(found, counted), batch_id)
        registry.write(P.record_predictions(known, found, counted), batch_id)

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
