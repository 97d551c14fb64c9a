"""Keyed cache tables: neighbour frames and field predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour_rows(closure: DataFrame, version: int) -> DataFrame:
    """(memory_id, neighbors, version, built_at), neighbours ordered by (-boost, hop, id), boost at eight decimals."""
    entry = F.struct(
        (-F.round("boost", 8)).alias("order"), F.col("hop").alias("hop"), F.col("id").alias("id"), F.round("boost", 8).alias("boost")
    )
    return closure.groupBy(F.col("root").alias("memory_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        "memory_id",
        F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["boost"].alias("boost"), e["hop"].alias("hop"))).alias("neighbors"),
        F.lit(version).alias("version"),
        F.current_timestamp().alias("built_at"),
    )


def write_neighbours(rows: DataFrame, path: str, buckets: int | None = None, table: str | None = None) -> None:
    """Replace the cache; with `table` it is bucketed by memory_id so later joins on the id need no shuffle."""
    if table:
        rows.write.mode("overwrite").option("path", path).bucketBy(buckets or 64, "memory_id").sortBy("memory_id").saveAsTable(table)
    else:
        rows.write.mode("overwrite").parquet(path)


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key of both tables; the incoming row wins at equal order."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n", "_new")


def cached_frame_scores(base: DataFrame, seeds: DataFrame, closure: DataFrame, boost: float) -> DataFrame:
    """(q, id, score): neighbours of the seeds at base + .35 seed + boost x strength / (hop + 1); an uncached seed keeps its own."""
    asked = seeds.select("q", F.col("id").alias("root"), F.col("score").alias("seed"))
    origin = base.select("q", "id", F.col("score").alias("base"))
    found = (
        asked.join(closure, "root")
        .join(origin, ["q", "id"])
        .select("q", "id", (F.col("base") + 0.35 * F.col("seed") + boost * F.col("boost") / (F.col("hop") + 1)).alias("score"))
    )
    missed = asked.join(closure.select("root").distinct(), "root", "left_anti").select("q", F.col("root").alias("id"), F.col("seed").alias("score"))
    return found.unionByName(missed).groupBy("q", "id").agg(F.max("score").alias("score"))
