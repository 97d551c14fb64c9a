"""Keyed feedback state and the online loop against event-by-event plain versions."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memjoin.functions.state import card_state, falsy_default, state_score
from memjoin.operators import feedback as B
from memjoin.streaming import folds
from memjoin.streaming import online as O

EVENTS = "memory_id bigint, seq bigint, outcome string, protected boolean"


def events(spark, count=1200, seed=1):
    """A third of the events belong to one memory; one memory is only ever ignored."""
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        memory = 7 if rng.random() < 0.34 else rng.randrange(60)
        rows.append((memory, seq, "ignored" if memory == 3 else rng.choice(["helpful", "corrected", "ignored"]), rng.random() < 0.02))
    return spark.createDataFrame(rows, EVENTS)


def table(df):
    names = ["memory_id", *folds.names()]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in df.select(*names).collect())


def state_bytes(checkpoint):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{checkpoint}/state") for f in files)


def test_keyed_state_follows_the_log(spark, tmp_path):
    source, checkpoint = str(tmp_path / "events"), str(tmp_path / "state")
    rows, written = events(spark), []
    bounds = [(0, 600), (600, 1190), (1190, 1200)]
    for low, high in bounds:
        rows.where(f"seq >= {low} and seq < {high}").write.mode("append").parquet(source)
        before = state_bytes(checkpoint)
        folds.fold_stream(spark.readStream.schema(rows.schema).parquet(source), checkpoint).awaitTermination()
        written.append(state_bytes(checkpoint) - before)
    assert table(folds.state_table(spark, checkpoint)) == table(B.memory_state(rows))
    assert table(folds.state_table(spark, checkpoint, batch=1)) == table(B.memory_state(rows.where("seq < 1190")))
    assert written[2] < written[1] / 2  # ten events touch few keys
    folds.fold_stream(spark.readStream.schema(rows.schema).parquet(source), checkpoint).awaitTermination()  # nothing new
    assert table(folds.state_table(spark, checkpoint)) == table(B.memory_state(rows))


def test_signature_state(spark, tmp_path):
    source, checkpoint = str(tmp_path / "events"), str(tmp_path / "state")
    rows = events(spark).select(F.concat(F.lit("s"), F.col("memory_id") % 3).alias("signature"), "seq", "outcome", "protected")
    rows.repartition(5).write.parquet(source)
    folds.fold_stream(spark.readStream.schema(rows.schema).parquet(source), checkpoint, folds.SIGNATURE).awaitTermination()
    held = folds.state_table(spark, checkpoint, folds.SIGNATURE).select("signature", F.round("score_bias", 9).alias("bias"), F.expr("n_helpful + n_corrected + n_ignored").alias("n"))
    expected = B.signature_state(rows).select("signature", F.round("bias", 9).alias("bias"), "n")
    assert sorted(held.collect()) == sorted(expected.collect())


def test_runs_compose_only_without_gaps():
    import pandas as pd

    frame = pd.DataFrame({"memory_id": [1, 1, 2, 1, 1], "seq": [0, 1, 2, 5, 6], "outcome": ["helpful"] * 5, "protected": [False, True, False, False, False]})
    (out,) = folds.run_maker(folds.MEMORY)(iter([frame]))
    assert sorted(zip(out.memory_id, out["at"], out.n_helpful, out.protected)) == [(1, 0, 2, True), (1, 5, 2, False), (2, 2, 1, False)]


# ---------------------------------------------------------------- the loop

ASKED = "q bigint, turn bigint, asked string, source_index bigint"
PAIRS = (
    "q bigint, id bigint, lexical_share double, text string, cost bigint, role string, same_context boolean, other_context boolean, context string, relation string, duplicate string, "
    "importance double, age_days bigint, use_count bigint, evidence_count bigint, last_outcome string, protected boolean"
)
NAMES = [part.split()[0] for part in PAIRS.split(", ")]


def scorer():
    return F.col("lexical_share") + 0.09 * falsy_default(F.col("importance"), 0.5) + state_score(card_state())


def plain_score(card):
    import math

    use, evidence = (min(1.0, math.log1p(card[k]) / math.log1p(m)) for k, m in (("use_count", 100), ("evidence_count", 50)))
    outcome = {"helpful": 1.0, "corrected": 0.35, "ignored": -0.65}.get(card["last_outcome"], 0.0)
    stale = card["age_days"] >= 180 and card["use_count"] <= 0 and not card["protected"]
    age = min(1.0, card["age_days"] / 365)
    standing = 0.18 * use + 0.16 * evidence + 0.12 * max(0, outcome) + 0.08 * card["protected"] + 0.07 * (1 - age) - 0.22 * stale - 0.10 * max(0, -outcome)
    return card["lexical_share"] + 0.09 * (card["importance"] or 0.5) + standing


def workload(seed=11, queries=5, memories=8, width=5):
    rng = random.Random(seed)
    cards = {
        m: dict(importance=rng.choice([0.0, 0.3, 0.8]), age_days=rng.randrange(400), use_count=rng.randrange(3), evidence_count=rng.randrange(4), last_outcome=rng.choice(["", "helpful", "ignored"]), protected=rng.random() < 0.2)
        for m in range(memories)
    }
    rows = []
    for q in range(queries):
        for m in rng.sample(range(memories), width):
            same = rng.random() < 0.5
            rows.append(dict(
                q=q, id=m, lexical_share=rng.randrange(100) / 100, text=f"{rng.choice(['Current preference: ', 'no longer ', ''])}text {m}", cost=rng.randrange(1, 5), role=f"r{m % 3}", same_context=same, other_context=not same,
                context="same_project" if same else "cross_project", relation="preference_unknown", duplicate=rng.choice(["distinct", "duplicate_like"]), **cards[m],
            ))
    relevant = {(q, rng.randrange(memories)) for q in range(1, queries) for _ in range(2)}
    return rows, relevant


def plain_loop(rows, relevant, policy, gated):
    """The serial loop, one event after another."""
    memory, signature, out = {}, defaultdict(float), {}
    for q in sorted({r["q"] for r in rows}):
        cards = [dict(r) for r in rows if r["q"] == q]
        if gated[q]:
            for c in cards:
                s = memory.get(c["id"])
                if s:
                    c["use_count"] += s["use"]
                    c["evidence_count"] += s["evidence"]
                    c["importance"] = min(0.95, max(0.05, (c["importance"] or 0.5) + s["importance"]))
                    c["last_outcome"] = s["last"] or c["last_outcome"]
                    c["protected"] = c["protected"] or s["protected"]
        for c in cards:
            stale = c["age_days"] >= 180 and c["use_count"] <= 0 and not c["protected"]
            c["signature"] = "|".join([c["context"], c["relation"], "stale" if stale else "fresh_or_used", c["duplicate"]])
            c["score"] = plain_score(c)
            if gated[q]:
                c["score"] += policy.scale * (memory.get(c["id"], {}).get("bias", 0.0) + signature[c["signature"]])
        cards.sort(key=lambda c: (-round(c["score"], 9), c["id"]))
        used, inside = 0, []
        for c in cards:
            used += c["cost"]
            if used > policy.budget:
                break
            inside.append(c["id"])
        wanted = {i for a, i in relevant if a == q}
        out[q] = ([c["id"] for c in cards], inside, len(wanted & {c["id"] for c in cards[: policy.top_k]}) / len(wanted) if wanted else 0.0)
        if not gated[q]:
            continue
        by_id = {c["id"]: c for c in cards}
        order = [c["id"] for c in cards] + sorted(wanted - set(by_id))
        for i in order:
            if i not in inside and i not in wanted:
                continue
            outcome = "helpful" if i in inside and i in wanted else "ignored" if i in inside else "corrected"
            s = memory.setdefault(i, dict(use=0, evidence=0, importance=0.0, bias=0.0, last="", protected=False))
            s["use"] += B.USE_STEP[outcome]
            s["evidence"] += B.EVIDENCE_STEP[outcome]
            s["importance"] = min(0.45, max(-0.45, s["importance"] + B.IMPORTANCE_STEP[outcome]))
            s["bias"] = min(0.9, max(-0.9, s["bias"] + B.BIAS_STEP[outcome]))
            s["last"], s["protected"] = outcome, s["protected"] or by_id.get(i, {}).get("protected", False)
            if i in by_id:
                name = by_id[i]["signature"]
                signature[name] = min(0.35, max(-0.35, signature[name] + B.SIGNATURE_STEP[outcome]))
    return memory, signature, out


@pytest.mark.parametrize("policy", [O.Policy("uncertainty_gated", 0.5, gate_margin=0.05, top_k=2, budget=9)], ids=lambda p: p.name)
def test_batches_of_one_are_the_serial_loop(spark, tmp_path, policy):
    rows, relevant = workload()
    pairs = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], PAIRS).cache()
    rel = spark.createDataFrame(sorted(relevant), "q bigint, id bigint").cache()
    asked = spark.createDataFrame([(q, q, "The preference changed" if q % 2 else "what", q) for q in range(5)], ASKED)
    log = O.BatchLog(spark, str(tmp_path / "log"))
    gated = {r.q: r.gated for r in O.gates(asked, pairs, scorer, policy).collect()}
    for q in range(5):
        O.run_batch(log, q, asked.where(f"q = {q}"), pairs, rel, scorer, policy)
    memory, signature, out = plain_loop(rows, relevant, policy, gated)
    held = {r.memory_id: r for r in log.state("memory", O.MEMORY, "memory_id").collect()}
    assert {m: (r.use_count_delta, r.evidence_count_delta, round(r.importance_delta, 9), round(r.score_bias, 9), r.last_outcome, r.protected) for m, r in held.items()} == {
        m: (s["use"], s["evidence"], round(s["importance"], 9), round(s["bias"], 9), s["last"], s["protected"]) for m, s in memory.items()
    }
    biases = {r.signature: round(r.bias, 9) for r in log.state("signature", O.SIGNATURE, "signature").collect()}
    assert biases == {name: round(v, 9) for name, v in signature.items() if name in biases} and set(biases) == {n for n, v in signature.items() if n in biases or v}
    metrics = {r.q: r for r in O.metric_rows(log, policy).collect()}
    for q, (_, inside, recall) in out.items():
        assert metrics[q].included_count == len(inside) and round(metrics[q].recall_at_k, 9) == round(recall, 9) and metrics[q].gated == gated[q]
    if policy.name == "uncertainty_gated":
        assert 0 < sum(gated.values()) < 5
    sections = {r.section for r in O.summary(log, policy).collect()}
    assert sections == {"evolved", "confidence", "rate", "role", "feedback", "state"}


def test_replayed_and_broken_batches(spark, tmp_path):
    rows, relevant = workload(seed=3, queries=3)
    pairs = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], PAIRS)
    rel = spark.createDataFrame(sorted(relevant), "q bigint, id bigint")
    asked = spark.createDataFrame([(q, q, "what", q) for q in range(3)], ASKED)
    policy, path = O.Policy("always", 0.35, top_k=3, budget=9), str(tmp_path / "log")
    log = O.BatchLog(spark, path)
    O.run_batch(log, 0, asked.where("q = 0"), pairs, rel, scorer, policy)
    before = sorted(log.state("memory", O.MEMORY, "memory_id").collect())
    O.run_batch(log, 0, asked.where("q = 1"), pairs, rel, scorer, policy)  # replayed number: nothing happens
    assert sorted(log.state("memory", O.MEMORY, "memory_id").collect()) == before
    # A batch that broke off before its manifest row does not count, and its parts are overwritten.
    spark.createDataFrame([(1, 99, 99, 9.0, 9.0, "helpful", True, 9, 9, 9, 1)], f"{O.MEMORY}, batch bigint").write.parquet(f"{path}/batch=1/memory")
    assert sorted(O.BatchLog(spark, path).state("memory", O.MEMORY, "memory_id").collect()) == before
    O.run_batch(log, 1, asked.where("q = 1"), pairs, rel, scorer, policy)
    assert all(r.use_count_delta < 99 for r in log.state("memory", O.MEMORY, "memory_id").collect()) and set(log.manifest()) == {0, 1}


def test_whole_states_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "FULL", 2)
    rows, relevant = workload(seed=5, queries=3)
    pairs = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], PAIRS)
    rel = spark.createDataFrame(sorted(relevant), "q bigint, id bigint")
    asked = spark.createDataFrame([(q, q, "what", q) for q in range(3)], ASKED)
    policy, log = O.Policy("always", 0.35, top_k=3, budget=9), O.BatchLog(spark, str(tmp_path / "log"))
    for q in range(3):
        O.run_batch(log, q, asked.where(f"q = {q}"), pairs, rel, scorer, policy)
    memory, _, _ = plain_loop(rows, relevant, policy, dict.fromkeys(range(3), True))
    assert log.manifest() == {0: 0, 1: 0, 2: 2}
    assert {r.memory_id: round(r.score_bias, 9) for r in log.state("memory", O.MEMORY, "memory_id").collect()} == {m: round(s["bias"], 9) for m, s in memory.items()}
