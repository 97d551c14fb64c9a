"""Exact dedup [native]: stateful streaming over content digests, without expiry, with a check of the full bytes.

The digests of arriving rows go to an arrivals folder; a stream folds them into keyed state on disk (RocksDB, checkpointed
to the shared folder), one entry per digest: the largest doc_id, the place (file, row) of that row's content, and the count.
Only digests enter the state, so it stays small against the texts. The state is then read as a table and joined back.
A digest that two different texts share is found by counting the texts of each digest, byte by byte, and such rows are
grouped by the text itself.

Defined cases: a null text counts as empty; texts are equal when they are identical after lower-casing A-Z; a null doc_id is
below every other; of rows with the same text and doc_id the one with the last (file, row) stays, so exactly one row of each
group is kept; an empty table gives no rows; other columns are not read (`drop_copies` keeps them untouched).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import LOC, documents, drop_rows, located, lower_ascii, scratch_path

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside for each
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def fold(spark: SparkSession, arrivals: str, schema, bytes_per_batch: int) -> DataFrame:
    """Run the stream over everything in `arrivals`; the state as (digest, last, n)."""
    checkpoint = scratch_path(spark, "dedup-state")
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        incoming = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(arrivals)
        folded = incoming.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("last"), F.count("*").alias("n"))
        stream = folded.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        state = spark.read.format("statestore").option("path", checkpoint).load()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    key, value = state.schema["key"].dataType.names, state.schema["value"].dataType.names
    return state.select(F.col("key")[key[0]].alias("digest"), F.col("value")[value[0]].alias("last"), F.col("value")[value[1]].alias("n"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """(doc_id, file, row, digest, keep_id, group_size, kept) for every row of `docs`."""
    spark = docs.sparkSession
    placed = located(docs.select("doc_id", "text"))
    texts = placed.select("doc_id", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), normalised(F.col("text")).alias("content"))
    texts = texts.withColumn("digest", F.unhex(digest(F.col("content"))))
    path = scratch_path(spark, "arrivals")
    rows = texts.select("digest", "doc_id", "file", "row")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    state = fold(spark, path, rows.schema, bytes_per_batch)
    groups = decided(rows.join(state, "digest"))
    # Copies meet before the shuffle: each task sends one row for each text that it holds.
    shared = texts.groupBy("digest", "content").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    shared_path = scratch_path(spark, "collisions")
    shared.write.parquet(shared_path)
    shared = spark.read.schema(shared.schema).parquet(shared_path)
    if shared.isEmpty():
        return groups
    unlike = texts.join(shared, "digest", "left_semi")
    by_text = unlike.groupBy("digest", "content").agg(F.max(F.struct("doc_id", "file", "row")).alias("last"), F.count("*").alias("n"))
    settled = decided(unlike.join(by_text, ["digest", "content"]))
    return groups.join(shared, "digest", "left_anti").unionByName(settled)


def decided(rows: DataFrame) -> DataFrame:
    place = F.struct("doc_id", "file", "row")
    return rows.select(
        "doc_id", "file", "row", "digest", F.col("last")["doc_id"].alias("keep_id"), F.col("n").alias("group_size"),
        place.eqNullSafe(F.col("last")).alias("kept"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without the copies."""
    return drop_rows(docs, lambda rows: exact_groups(rows).where("not kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY content)
"""
