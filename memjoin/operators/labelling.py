"""Incremental labelling: items whose text is not in the cache are labelled in commits of bounded size, and a job that was
killed goes on where its last commit ended.

The cache is a log of committed batches: each holds the predictions of its keys (deduplicated, confidence at eight places) and
an audit row for the item that was labelled. Registry counters are derived from the log, so they cannot run ahead of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjoin.operators import fields as P
from memjoin.session import cut_lineage
from memjoin.sources.jsonl import numbered
from memjoin.streaming.online import BatchLog

PLACES = 8
ONE = "struct<field:string,value:string,confidence:double,span:string>"
CACHE = f"key string, predictions array<{ONE}>"
AUDIT = "item_id bigint, index bigint, key string, prediction_count int"


def cached(log: BatchLog) -> DataFrame:
    """(key, predictions): the newest entry of every key."""
    rows = log.part("predictions", CACHE, sorted(log.manifest()))
    return rows.groupBy("key").agg(F.max_by("predictions", "batch").alias("predictions"))


def audit(log: BatchLog) -> DataFrame:
    return log.part("audit", AUDIT, sorted(log.manifest()))


def classifier(kind: str, log: BatchLog | None = None) -> Callable[[DataFrame], DataFrame]:
    """A labelling step (key, text) -> (key, pos, field, value, confidence, span): `none` predicts nothing, `rules` applies
    the patterns, `cache` repeats what the log holds and predicts nothing for other keys."""
    if kind == "rules":
        return lambda items: P.extract(items, "key")
    if kind == "none":
        return lambda items: P.extract(items, "key").limit(0)
    if kind == "cache":
        if log is None:
            raise ValueError("a cache classifier needs a log")
        return lambda items: items.select("key").join(cached(log), "key").select("key", F.posexplode("predictions").alias("pos", "p")).select("key", "pos", "p.*")
    raise ValueError(f"unknown classifier: {kind}")


def entries(keys: DataFrame, predictions: DataFrame) -> DataFrame:
    """(key, predictions): the stable predictions of every key, in order of field and value; none is an empty list."""
    best = P.stable_predictions(predictions.withColumnRenamed("key", "item")).select(
        F.col("item").alias("key"), F.struct("field", "value", F.round("confidence", PLACES).alias("confidence"), "span").alias("p")
    )
    listed = best.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("predictions"))
    return keys.select("key").join(listed, "key", "left").withColumn("predictions", F.coalesce("predictions", F.array().cast(f"array<{ONE}>")))


def label_job(items: DataFrame, log: BatchLog, classify: Callable[[DataFrame], DataFrame], save_every: int, refresh: bool = False, stop_after: int | None = None) -> int:
    """Label what the log does not hold and return the number of commits. `items`: index, item_id, key, text.

    The first item of a key is labelled, later ones find it in the cache. `stop_after` ends the job after some commits, as a
    lost driver would.
    """
    first = items.groupBy("key").agg(F.min_by(F.struct("index", "item_id", "text"), "index").alias("i")).select("key", "i.*")
    open_ = first if refresh else first.join(cached(log).select("key"), "key", "left_anti")
    placed = cut_lineage(numbered(cut_lineage(open_.orderBy("index"))))
    commits = -(-placed.count() // save_every)
    number = max(log.manifest(), default=-1) + 1
    for commit in range(commits if stop_after is None else min(commits, stop_after)):
        part = placed.where(F.floor(F.col("pos") / save_every) == commit)
        listed = log.stage(number + commit, "predictions", entries(part, classify(part.select("key", "text"))))
        rows = part.select("item_id", "index", "key").join(listed, "key").select("item_id", "index", "key", F.size("predictions").alias("prediction_count"))
        log.commit(number + commit, {"audit": rows}, {})
    return commits


def outcome(items: DataFrame, log: BatchLog) -> DataFrame:
    """(index, item_id, state, predictions) of every item that the log covers: `labelled` where its own text was sent to the
    classifier, else `cached`."""
    done = audit(log).select("index", "item_id", F.lit("labelled").alias("state")).distinct()
    found = items.join(cached(log), "key").join(done, ["index", "item_id"], "left")
    return found.select("index", "item_id", F.coalesce("state", F.lit("cached")).alias("state"), "predictions")


def registry(items: DataFrame, log: BatchLog, seed: DataFrame) -> DataFrame:
    """The registry with the predictions of every item recorded, cached ones too."""
    rows = items.join(cached(log), "key").select(F.col("item_id").alias("item"), F.posexplode("predictions").alias("pos", "p")).select("item", "pos", "p.*")
    return P.record_predictions(seed, P.resolved(rows, seed))
