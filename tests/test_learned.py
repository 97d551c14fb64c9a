"""Learned rerankers on held-out queries of made-up records: what the heads learn must beat the base ranking."""

import random

import pytest
from pyspark.sql import functions as F

from memjoin.operators import learn as L
from memjoin.operators import rollups as U
from memjoin.operators.ranking import ranked

ROWS = "q bigint, id bigint, score double, label double, include_weight double, utility_target double, stale double, never double, x array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    """Ten candidates a query, two of them needed; the features tell which, the base score hardly does."""
    rng = random.Random(4)
    out = []
    for q in range(90):
        needed = set(rng.sample(range(10), 2))
        for i in range(10):
            label, stale = float(i in needed), float(rng.random() < 0.3)
            x = [label + rng.gauss(0, 0.4), stale + rng.gauss(0, 0.3), rng.random(), rng.random()]
            cost = rng.randrange(10, 400)
            out.append((q, 100 * q + i, rng.random() + 0.1 * label, label, 1.0 if label else 2.0, 1.0 if label else -cost / 900, stale, 0.0, x))
    return ranked(spark.createDataFrame(out, ROWS), "q").cache()


@pytest.fixture(scope="module")
def heads(rows):
    train, _ = L.split(rows)
    return L.fit_head(train, "x", "label"), L.fit_head(train, "x", "label", "include_weight"), L.fit_utility(train, "x", "utility_target", "include_weight")


def first_hit(df):
    return df.where("label = 1").groupBy("q").agg(F.min("rank").alias("r")).agg(F.avg(1 / F.col("r"))).first()[0]


def test_splits_keep_queries_whole(rows):
    parts = [{r.q for r in p.select("q").distinct().collect()} for p in L.three_ways(rows)]
    assert all(parts) and sum(map(len, parts)) == 90 == len(set.union(*parts))


def test_calibrated_rerank_beats_the_base_ranking(rows, heads):
    held = L.split(rows)[1]
    relevance, include, worth = heads
    plain = L.calibrated_rerank(held, relevance, include, "x", 10)
    full = L.calibrated_rerank(held, relevance, include, "x", 10, utility_model=worth)
    assert first_hit(plain) > first_hit(held) + 0.2 and first_hit(full) > first_hit(held) + 0.2
    assert first_hit(L.calibrated_rerank(held, relevance, None, "x", 10)) > first_hit(held) + 0.2
    row = full.select("include_probability", "utility", (F.col("score") - 0.35 * F.col("relevance_logit") - 0.6 * F.col("include_logit") - 0.05 * F.col("base_score") - 0.05 * F.col("utility")).alias("rest")).first()
    assert 0 < row.include_probability < 1 and -1 < row.utility < 1 and abs(row.rest) < 1e-9
    worthy = full.groupBy("label").agg(F.avg("utility").alias("u")).collect()
    assert {r.label: r.u for r in worthy}[1.0] > {r.label: r.u for r in worthy}[0.0] + 0.3


def test_cascade_keeps_survivors_and_their_order(rows, heads):
    train, held = L.split(rows)
    cheap = L.fit_head(train, "x", "label", reg=0.1, iterations=3)
    out = L.cascade_rerank(held, cheap, heads[:2], "x", 10, 4)
    full = {(r.q, r.id): r.score for r in L.calibrated_rerank(held, *heads[:2], "x", 10).collect()}
    found = out.collect()
    assert all(abs(full[r.q, r.id] - r.score) < 1e-9 for r in found) and max(r["rank"] for r in found) == 4
    assert first_hit(out) > first_hit(held) + 0.2


def test_auxiliary_heads_and_thresholds(rows):
    train, chosen, reported = L.three_ways(rows)
    fitted = L.fit_flags(train, "x", ["label", "stale", "never"])
    assert set(fitted) == {"label", "stale"}  # a flag that never varies has no head
    tuned = {r.label: r for r in U.tune_thresholds(L.flag_samples(fitted, chosen, "x")).collect()}
    for name, row in tuned.items():
        samples = L.flag_samples(fitted, reported, "x").where(F.col("label") == name).collect()
        tp = sum(s.score >= row.threshold and s.expected == 1 for s in samples)
        wrong = sum((s.score >= row.threshold) != (s.expected == 1) for s in samples)
        share = sum(s.expected for s in samples) / len(samples)
        assert 2 * tp / (2 * tp + wrong) > 2 * share / (1 + share) + 0.2  # better than calling every row positive
