"""Feedback labels, memory state, policies and bias.

Clamped adds depend on order, but they compose: a run of events acts on a value x as clamp(x + shift, low, high), and two
such runs in a row are again one. So events are folded in bounded slices of the sequence, then slices of slices, and a
memory holding a third of all events is never gathered in one task. The result equals the event-by-event fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.text import clamp, contains_any

# Steps and bounds of the memory and signature states, policy thresholds, preference markers.
OUTCOMES = ["helpful", "corrected", "ignored"]
IMPORTANCE_STEP, IMPORTANCE_BOUND = {"helpful": 0.04, "corrected": 0.07, "ignored": -0.06}, 0.45
BIAS_STEP, BIAS_BOUND = {"helpful": 0.16, "corrected": 0.22, "ignored": -0.20}, 0.9
SIGNATURE_STEP, SIGNATURE_BOUND = {"helpful": 0.035, "corrected": 0.05, "ignored": -0.045}, 0.35
USE_STEP = {"helpful": 1, "corrected": 1, "ignored": 0}
EVIDENCE_STEP = {"helpful": 1, "corrected": 2, "ignored": 0}
CARD_IMPORTANCE = (0.05, 0.95)
CROWDING = 0.03
CURRENT_MARKERS = ["updated preference", "current preference", "current correction", "latest preference", "preference changed", "user now", "now "]
STALE_MARKERS = ["old preference:", "old preference.", "used to", "before the change", "before the correction", "superseded", "no longer", "obsolete"]
SLICE = 4096


def by_outcome(outcome: Column, steps: dict[str, float]) -> Column:
    out = F.lit(steps["ignored"])
    for name in ("helpful", "corrected"):
        out = F.when(outcome == name, F.lit(steps[name])).otherwise(out)
    return out


def _run(shift: Column, bound: float) -> Column:
    return F.struct(shift.cast("double").alias("shift"), F.lit(-bound).alias("low"), F.lit(bound).alias("high"))


def _then(first: Column, second: Column) -> Column:
    """The run `first` followed by the run `second`."""

    def moved(edge: Column) -> Column:
        return F.greatest(second["low"], F.least(second["high"], edge + second["shift"]))

    return F.struct((first["shift"] + second["shift"]).alias("shift"), moved(first["low"]).alias("low"), moved(first["high"]).alias("high"))


def _applied(run: Column, start: Column) -> Column:
    return F.greatest(run["low"], F.least(run["high"], start + run["shift"]))


def _composed(entries: str, name: str) -> Column:
    """All runs `name` of an ordered array of entries as one run."""
    return F.aggregate(F.slice(entries, 2, F.size(entries)), F.get(entries, F.lit(0))[name], lambda acc, e: _then(acc, e[name]))


def clamped_folds(events: DataFrame, key: str, runs: dict[str, Column], seq: str, slices: int | None = None) -> DataFrame:
    """(key, one run struct per name): ordered composition of the events' runs, `SLICE` sequence numbers per task group.

    `seq` must be unique. The number of levels follows from the largest sequence number, read once.
    """
    size = slices or SLICE
    rows = events.select(key, F.col(seq).alias("at"), *[run.alias(name) for name, run in runs.items()])
    top = events.agg(F.max(seq)).first()[0] or 0
    while True:
        entry = F.struct("at", *runs)
        grouped = rows.groupBy(key, F.floor(F.col("at") / size).alias("slice")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        rows = grouped.select(key, F.col("slice").alias("at"), *[_composed("e", name).alias(name) for name in runs])
        top = top // size
        if top == 0:
            return rows.drop("at")


def memory_runs() -> dict[str, Column]:
    return {
        "importance": _run(by_outcome(F.col("outcome"), IMPORTANCE_STEP), IMPORTANCE_BOUND),
        "bias": _run(by_outcome(F.col("outcome"), BIAS_STEP), BIAS_BOUND),
    }


def memory_counts(events: DataFrame) -> DataFrame:
    """Per memory what does not depend on the clamps: counts, last outcome, sticky protection."""
    return events.groupBy("memory_id").agg(
        F.sum(by_outcome(F.col("outcome"), USE_STEP)).cast("bigint").alias("use_count_delta"),
        F.sum(by_outcome(F.col("outcome"), EVIDENCE_STEP)).cast("bigint").alias("evidence_count_delta"),
        F.max_by("outcome", "seq").alias("last_outcome"),
        F.bool_or("protected").alias("protected"),
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES],
    )


def memory_state(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Per memory: counts, clamped importance delta and bias, last outcome, sticky protection. `events`: memory_id, seq, outcome, protected."""
    folds = clamped_folds(events, "memory_id", memory_runs(), "seq", slices)
    zero = F.lit(0.0)
    return memory_counts(events).join(folds, "memory_id").select(
        "memory_id", "use_count_delta", "evidence_count_delta",
        _applied(F.col("importance"), zero).alias("importance_delta"), _applied(F.col("bias"), zero).alias("score_bias"), "last_outcome", "protected", *[f"n_{o}" for o in OUTCOMES],
    )


def signature_state(events: DataFrame, slices: int | None = None) -> DataFrame:
    """(signature, bias, n): clamped bias per relationship signature. `events`: signature, seq, outcome."""
    folds = clamped_folds(events, "signature", {"bias": _run(by_outcome(F.col("outcome"), SIGNATURE_STEP), SIGNATURE_BOUND)}, "seq", slices)
    counts = events.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(folds, "signature").select("signature", _applied(F.col("bias"), F.lit(0.0)).alias("bias"), "n")


def merge_state(current: DataFrame, events: DataFrame) -> DataFrame:
    """State after more events: the new events' runs are applied to the stored values, as if folded one by one."""
    folds = clamped_folds(events, "memory_id", memory_runs(), "seq")
    counts = memory_counts(events)
    fresh = counts.select("memory_id", *[F.col(c).alias(f"new_{c}") for c in counts.columns if c != "memory_id"])
    joined = current.join(fresh.join(folds, "memory_id"), "memory_id", "full_outer")
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)

    def total(name: str) -> Column:
        return (F.coalesce(name, zero) + F.coalesce(f"new_{name}", zero)).alias(name)

    def carried(run: str, value: str) -> Column:
        start = F.coalesce(value, none)
        return F.when(F.col(run).isNotNull(), _applied(F.col(run), start)).otherwise(start).alias(value)

    return joined.select(
        "memory_id", total("use_count_delta"), total("evidence_count_delta"), carried("importance", "importance_delta"), carried("bias", "score_bias"),
        F.coalesce("new_last_outcome", "last_outcome").alias("last_outcome"), (F.coalesce("protected", F.lit(False)) | F.coalesce("new_protected", F.lit(False))).alias("protected"),
        *[total(f"n_{o}") for o in OUTCOMES],
    )


def merge_signatures(current: DataFrame, events: DataFrame) -> DataFrame:
    """Signature states (signature, bias, n) after more events."""
    folds = clamped_folds(events, "signature", {"run": _run(by_outcome(F.col("outcome"), SIGNATURE_STEP), SIGNATURE_BOUND)}, "seq")
    fresh = events.groupBy("signature").agg(F.count(F.lit(1)).alias("new_n"))
    joined = current.join(fresh.join(folds, "signature"), "signature", "full_outer")
    start, zero = F.coalesce("bias", F.lit(0.0)), F.lit(0).cast("bigint")
    moved = F.when(F.col("run").isNotNull(), _applied(F.col("run"), start)).otherwise(start)
    return joined.select("signature", moved.alias("bias"), (F.coalesce("n", zero) + F.coalesce("new_n", zero)).alias("n"))


def feedback_labels(packed: DataFrame, relevance: DataFrame) -> DataFrame:
    """(q, id, outcome): packed and relevant helpful, packed only ignored, relevant only corrected."""
    both = packed.select("q", "id").distinct().withColumn("in_context", F.lit(True)).join(relevance.select("q", "id").distinct().withColumn("relevant", F.lit(True)), ["q", "id"], "full_outer")
    return both.select("q", "id", F.when(F.col("in_context").isNull(), "corrected").when(F.col("relevant").isNull(), "ignored").otherwise("helpful").alias("outcome"))


def apply_state(cards: DataFrame, state: DataFrame) -> DataFrame:
    """Cards with the state's counts added, importance shifted and clamped, last outcome and protection taken over."""
    held = state.select(F.col("memory_id").alias("id"), "use_count_delta", "evidence_count_delta", "importance_delta", F.col("last_outcome").alias("new_outcome"), F.col("protected").alias("new_protected"), F.lit(True).alias("touched"))
    joined = cards.join(held, "id", "left")
    base = F.when(F.col("importance").isNull() | (F.col("importance") == 0), 0.5).otherwise(F.col("importance"))
    changed = {
        "use_count": F.coalesce("use_count", F.lit(0)) + F.coalesce("use_count_delta", F.lit(0)),
        "evidence_count": F.coalesce("evidence_count", F.lit(0)) + F.coalesce("evidence_count_delta", F.lit(0)),
        "importance": F.when(F.col("touched"), clamp(base + F.col("importance_delta"), *CARD_IMPORTANCE)).otherwise(F.col("importance")),
        "last_outcome": F.coalesce(F.when(F.col("new_outcome") != "", F.col("new_outcome")), F.col("last_outcome")),
        "protected": F.coalesce("protected", F.lit(False)) | F.coalesce("new_protected", F.lit(False)),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in cards.columns])


def confidence_features(ranked: DataFrame, k: int) -> DataFrame:
    """(q, top_score, top_margin, cutoff_margin, score_spread, cutoff_crowding) of a ranked list."""
    n = F.max("rank").alias("n")

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("rank") == place, F.col("score")))

    size = ranked.groupBy("q").agg(n, F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.min("score").alias("low"))
    cut = F.least(F.lit(max(1, k)), F.col("n"))
    joined = ranked.join(size, "q")
    marks = joined.groupBy("q", "n", "top", "low").agg(at(F.lit(2)).alias("second"), at(cut).alias("cut"), at(cut + 1).alias("after"))
    crowd = ranked.join(marks.select("q", "cut"), "q").groupBy("q").agg(F.count_if(F.round(F.abs(F.col("score") - F.col("cut")), 9) <= CROWDING).alias("crowding"))
    return marks.join(crowd, "q").select(
        "q", F.col("top").alias("top_score"), F.when(F.col("n") > 1, F.col("top") - F.col("second")).otherwise(F.abs("top")).alias("top_margin"),
        (F.col("cut") - F.coalesce("after", "low")).alias("cutoff_margin"), (F.col("top") - F.col("low")).alias("score_spread"), F.col("crowding").cast("double").alias("cutoff_crowding"),
    )


def preference_change(text: Column) -> Column:
    lowered = F.lower(text)
    switched = lowered.contains(" used to ") & lowered.contains(" current ")
    return contains_any(text, ["preference changed", "current preference", "updated preference", "not the old preference"]) | switched


def state_risk(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """Counts over the packed cards. `queries`: q, asked (anchor and query text); `packed`: q, same_context, other_context, text, usage columns."""
    current = F.col("same_context") & contains_any(F.col("text"), CURRENT_MARKERS)
    busy = (F.col("use_count") >= 21) | (F.col("evidence_count") >= 8) | (F.col("last_outcome") == "helpful")
    old = F.col("same_context") & ~current & (F.col("age_days") >= 90) & busy
    sums = packed.groupBy("q").agg(
        F.count(F.lit(1)).alias("included"), F.count_if(current).alias("current"), F.count_if(contains_any(F.col("text"), STALE_MARKERS)).alias("stale"), F.count_if(old).alias("positive_old"),
        F.count_if(F.col("other_context")).alias("cross"),
    )
    rows = queries.join(sums, "q", "left").fillna(0)
    as_double = {name: F.col(name).cast("double") for name in ("included", "current", "stale", "positive_old", "cross")}
    return rows.select(
        "q", *[v.alias(f"{n}_count") for n, v in as_double.items()], (as_double["stale"] + as_double["positive_old"]).alias("stale_pressure"),
        (as_double["current"] / F.greatest(F.lit(1.0), as_double["included"])).alias("current_rate"), preference_change(F.col("asked")).cast("double").alias("preference_change"),
    )


def policy_allows(policy: str, gate_margin: float, low_score: float, low_spread: float) -> Column:
    """Whether a query may read and change state, from its confidence and risk columns."""
    c = F.col
    margin, crowding, top, spread = F.round("cutoff_margin", 9), c("cutoff_crowding"), F.round("top_score", 9), F.round("score_spread", 9)
    uncertain, weak = (margin <= gate_margin) | (crowding >= 4), (top <= low_score) | (spread <= low_spread)
    changing = c("preference_change") > 0
    if policy == "off":
        return F.lit(False)
    if policy == "always":
        return F.lit(True)
    if policy == "uncertainty_gated":
        return uncertain
    if policy == "low_confidence_only":
        return weak
    if policy == "risk_aware":
        present = (c("current_count") >= 2) | (c("current_rate") >= 0.25)
        crowded = (margin <= gate_margin) & (crowding >= 6) & (top <= low_score + 0.08)
        return F.when(~changing, uncertain | weak).otherwise(~present & (weak | crowded))
    if policy == "risk_rescue":
        thin = (c("current_count") < 3) | (c("current_rate") < 0.55)
        damaged = (top <= low_score + 0.15) | (spread <= max(2 * low_spread, 0.36)) | ((margin <= gate_margin) & (crowding >= 6))
        stale = (c("stale_pressure") >= 4) & (c("positive_old_count") >= 2) & (top <= low_score + 0.15)
        return F.when(~changing, uncertain | weak).otherwise(thin & (damaged | stale))
    raise ValueError(f"unknown policy: {policy}")


def oracle_scores(candidates: DataFrame, relevance: DataFrame) -> DataFrame:
    """(q, id, score): one for relevant ids, zero otherwise."""
    rel = relevance.select("q", "id").distinct().withColumn("hit", F.lit(1.0))
    return candidates.select("q", "id").join(rel, ["q", "id"], "left").select("q", "id", F.coalesce("hit", F.lit(0.0)).alias("score"))
