"""The incremental label job: commits, resume, refresh and the three classifiers."""

import pytest
from pyspark.sql import functions as F

from memjoin.operators import fields as P
from memjoin.operators import labelling as J
from memjoin.streaming.online import BatchLog

TEXTS = ["remember user_001 project_001", "use docker for project_002", "use docker for project_002", "", "nothing at all", "user_003 prefers project_001", None]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, 10 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "index bigint, item_id bigint, text string")
    return df.withColumn("key", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).cache()


def found(items, log):
    return sorted((r["index"], r.state, tuple(tuple(p) for p in r.predictions)) for r in J.outcome(items, log).collect())


def test_killed_and_resumed_job_equals_one_run(spark, items, tmp_path):
    whole, parts = BatchLog(spark, str(tmp_path / "whole")), BatchLog(spark, str(tmp_path / "parts"))
    assert J.label_job(items, whole, J.classifier("rules"), 100) == 1
    assert J.label_job(items, parts, J.classifier("rules"), 2, stop_after=1) == 3
    assert len(parts.manifest()) == 1
    # A commit that broke off before its manifest row leaves no entry.
    spark.createDataFrame([("k", [("f", "v", 1.0, "s")])], J.CACHE).withColumn("batch", F.lit(1).cast("bigint")).write.parquet(f"{parts.path}/batch=1/predictions")
    assert J.cached(parts).count() == 2
    J.label_job(items, parts, J.classifier("rules"), 2)
    assert found(items, parts) == found(items, whole) and J.cached(parts).count() == 5
    assert J.label_job(items, parts, J.classifier("rules"), 2) == 0  # nothing left
    states = [s for _, s, _ in found(items, whole)]
    assert states == ["labelled", "labelled", "cached", "labelled", "labelled", "labelled", "cached"]
    counters = lambda log: sorted((r.name, r.seen_count) for r in J.registry(items, log, P.seed_registry(spark)).collect())
    assert counters(parts) == counters(whole) and sum(n for _, n in counters(whole)) == sum(len(p) for _, _, p in found(items, whole)) > 3


def test_dry_run_writes_empty_entries_and_refresh_replaces_them(spark, items, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    J.label_job(items, log, J.classifier("none"), 100)
    assert J.cached(log).count() == 5 and all(not p for _, _, p in found(items, log))
    J.label_job(items, log, J.classifier("rules"), 100)
    assert all(not p for _, _, p in found(items, log))  # cached, so not labelled again
    J.label_job(items, log, J.classifier("rules"), 100, refresh=True)
    assert any(p for _, _, p in found(items, log)) and J.cached(log).count() == 5


def test_cache_classifier_repeats_the_log(spark, items, tmp_path):
    log, other = BatchLog(spark, str(tmp_path / "log")), BatchLog(spark, str(tmp_path / "other"))
    J.label_job(items.where("index < 2"), log, J.classifier("rules"), 100)
    J.label_job(items, other, J.classifier("cache", log), 100)
    rows = {i: p for i, _, p in found(items, other)}
    assert rows[0] and rows[1] == rows[2] and not rows[4] and not rows[5]
    with pytest.raises(ValueError):
        J.classifier("remote")
