"""Fixed-order feature vectors, labels, padded frames and the metrics over model scores.

Pair columns carry the prefix `a_` for the anchor card and `c_` for the candidate card; `toks`, `set`, `mask` and `vec`
are computed once per card before cards are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.hashing import activation_mask, hash_embedding
from memjoin.functions.state import card_state, falsy_default, state_adjustment
from memjoin.functions.text import clamp, contains_any, jaccard_sets, token_set, tokens
from memjoin.operators.graph import type_decay
from memjoin.operators.metrics import ratio
from memjoin.operators.vector import dot

# Marker words, thresholds, feature positions per ablation, reason classes and role groups.
PREFERENCE_MARKERS = ["preference", "prefer", "prefers", "preferred", "wants", "likes", "avoids", "needs"]
PREFERENCE_WORDS = ["prefer", "preference", "like", "dislike", "always", "never"]
CORRECTION_WORDS = ["correct", "instead", "actually", "wrong"]
CALIBRATION_CONFLICT = ["decoy", "wrong", "conflict", "contradict", "superseded", "obsolete", "ignored"]
EDGE_TYPE_IDS = {"same_cluster": 0, "same_context": 1, "preference": 2, "correction": 3, "same_topic": 4, "temporal_next": 5, "used_with": 6}
PREFERENCE_LIMIT, DUPLICATE_LIMIT, TOPIC_LIMIT, ATTACH_LIMIT = 0.34, 0.65, 0.18, 0.28
REASONS = ["same_context", "preference_memory", "cross_context_support", "stale_or_superseded", "wrong_context"]
AUXILIARY = ["relevant", "same_context", "preference_match", "preference_conflict", "cross_context", "stale_or_duplicate", "wrong_context"]
STALE_ROLES = [
    "stale_negative", "stale_same_context_negative", "stale_high_similarity_negative", "near_duplicate", "obsolete_preference_negative",
    "old_helpful_preference_negative",
]
PREFERENCE_ROLES = ["preference_relevant", "current_preference_relevant", "updated_same_project_relevant"]
CROSS_ROLES = ["cross_relevant"]
PREFERENCE_CONFLICT_ROLES = [
    "same_project_wrong_preference_negative", "contradicted_preference_negative", "obsolete_preference_negative", "old_helpful_preference_negative",
]


def let(value: Column, use) -> Column:
    """Bind `value` once inside an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def preference_terms(text: Column) -> Column:
    """Distinct tokens longer than one character among the four after each preference marker."""

    def after(toks: Column) -> Column:
        none = F.array().cast("array<string>")
        picked = F.transform(toks, lambda t, i: F.when(t.isin(PREFERENCE_MARKERS), F.slice(toks, i + 2, F.lit(4))).otherwise(none))
        return F.array_distinct(F.filter(F.flatten(picked), lambda t: F.length(t) > 1))

    return let(tokens(text), after)


def preference_overlap(left: Column, right: Column) -> Column:
    return jaccard_sets(left, right)


def preference_conflict(left: Column, right: Column) -> Column:
    known = (F.size(left) > 0) & (F.size(right) > 0)
    return (known & (jaccard_sets(left, right) < PREFERENCE_LIMIT)).cast("double")


def preference_relation(left: Column, right: Column) -> Column:
    unknown = (F.size(left) == 0) | (F.size(right) == 0)
    return (
        F.when(unknown, "preference_unknown")
        .when(jaccard_sets(left, right) >= PREFERENCE_LIMIT, "preference_match")
        .otherwise("preference_conflict")
    )


def relationship_signature(a: str = "a_", c: str = "c_") -> Column:
    """context|preference relation|freshness|duplicate of an (anchor, candidate) pair."""
    col = F.col
    same = (col(f"{a}cluster") != "") & (col(f"{a}cluster") == col(f"{c}cluster"))
    stale = (F.coalesce(f"{c}age_days", F.lit(0)) >= 180) & (F.coalesce(f"{c}use_count", F.lit(0)) <= 0) & ~F.coalesce(f"{c}protected", F.lit(False))
    return F.concat_ws(
        "|",
        F.when(same, "same_project").otherwise("cross_project"),
        preference_relation(col(f"{a}terms"), col(f"{c}terms")),
        F.when(stale, "stale").otherwise("fresh_or_used"),
        F.when(jaccard_sets(col(f"{a}set"), col(f"{c}set")) >= DUPLICATE_LIMIT, "duplicate_like").otherwise("distinct"),
    )


def prepared(cards: DataFrame) -> DataFrame:
    """Cards with the columns every pair feature reads."""
    toks = tokens(F.col("text"))
    return cards.select(
        "*",
        F.size(toks).alias("n"),
        token_set(F.col("text")).alias("set"),
        activation_mask(toks).alias("mask"),
        hash_embedding(toks).alias("vec"),
        preference_terms(F.col("text")).alias("terms"),
        falsy_default(F.col("importance"), 0.5).alias("weighty"),
    )


def neighbour_pairs(cards: DataFrame) -> DataFrame:
    """(q, id, a_*, c_*): each card of a record with the card before it as anchor."""
    ready = prepared(cards)
    names = [c for c in ready.columns if c not in ("q",)]
    card = F.struct(*names)
    rows = ready.select("q", card.alias("c"), F.lag(card).over(Window.partitionBy("q").orderBy("pos")).alias("a")).where(F.col("a").isNotNull())
    return rows.select("q", F.col("c.id").alias("id"), *[F.col(f"a.{n}").alias(f"a_{n}") for n in names], *[F.col(f"c.{n}").alias(f"c_{n}") for n in names])


def metadata_score(left: Column, right: Column) -> Column:
    """Share of the left map's entries the right map repeats; 0 when either is empty."""
    same = F.size(F.filter(F.map_entries(left), lambda e: F.try_element_at(right, e["key"]) == e["value"]))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(same / F.greatest(F.size(left), F.lit(1)))


def cluster_score() -> Column:
    return ((F.col("a_cluster") != "") & (F.col("a_cluster") == F.col("c_cluster"))).cast("double")


def with_pair_scores(pairs: DataFrame) -> DataFrame:
    """Add semantic, lexical, meta and cluster. Metadata is the map of speaker and session."""

    def metadata(side: str) -> Column:
        return F.create_map(F.lit("speaker"), F.col(f"{side}speaker"), F.lit("session_id"), F.col(f"{side}session").cast("string"))

    return pairs.select(
        "*",
        dot(F.col("a_vec"), F.col("c_vec")).alias("semantic"),
        jaccard_sets(F.col("a_set"), F.col("c_set")).alias("lexical"),
        metadata_score(metadata("a_"), metadata("c_")).alias("meta"),
        cluster_score().alias("cluster"),
    )


def state_features() -> dict[str, Column]:
    """The eight state values of a pair in their order."""
    c = card_state("c_")
    anchor_age = clamp(F.coalesce(F.col("a_age_days").cast("double"), F.lit(0.0)) / 365.0, 0.0, 1.0)
    names = ("age_norm", "use_norm", "evidence_norm", "outcome", "protected", "stale", "recency")
    return {"anchor_age": anchor_age, **{n: c[n] for n in names}}


def edge_type() -> Column:
    text = F.concat_ws(" ", "a_text", "c_text")
    return (
        F.when(F.col("cluster") > 0, "same_cluster")
        .when(F.col("meta") > 0.5, "same_context")
        .when(contains_any(text, PREFERENCE_WORDS), "preference")
        .when(contains_any(text, CORRECTION_WORDS), "correction")
        .when(F.col("lexical") > TOPIC_LIMIT, "same_topic")
        .otherwise("used_with")
    )


def heuristic_action(scored: DataFrame) -> DataFrame:
    """Edge proposal of every pair: score, type, weight, confidence, mask, decay, importance delta, attach."""
    base = 0.35 * F.col("semantic") + 0.20 * F.col("lexical") + 0.20 * F.col("meta") + 0.15 * F.col("cluster") + 0.05
    rows = scored.select("*", clamp(base + state_adjustment(card_state("c_")), 0.0, 1.0).alias("score"), edge_type().alias("type"))
    words = F.concat_ws(
        " ", "a_text", "a_cluster", "c_text", "c_cluster", "type", F.lit("speaker"), "a_speaker", F.lit("session_id"), F.col("a_session").cast("string"),
        F.lit("speaker"), "c_speaker", F.lit("session_id"), F.col("c_session").cast("string"),
    )
    return rows.select(
        "q",
        "id",
        "score",
        "type",
        clamp(0.2 + F.col("score"), 0.05, 1.2).alias("weight"),
        clamp(F.col("score"), 0.05, 1.0).alias("confidence"),
        activation_mask(tokens(words)).alias("mask"),
        type_decay(F.col("type")).alias("decay"),
        clamp((F.col("score") - 0.5) * 0.08, -0.04, 0.08).alias("importance_delta"),
        (F.col("score") >= ATTACH_LIMIT).alias("attach"),
    )


def edge_proposals(actions: DataFrame, keys: DataFrame, threshold: float = ATTACH_LIMIT, limit: int = 8) -> DataFrame:
    """Best `limit` attachable pairs per query; a query without any gets one row asking for a new cluster."""
    from memjoin.operators.ranking import top_k

    kept = top_k(actions.where(F.col("attach") & (F.col("score") >= threshold)), "q", limit)
    best = kept.groupBy("q").agg(F.max("score").alias("best"))
    rows = keys.select("q").join(best, "q", "left").join(kept.select("q", "id", "score", "rank"), "q", "left")
    return rows.select(
        "q", "id", "score", "rank", F.col("best").isNull().alias("new_cluster"), (1.0 - F.coalesce("best", F.lit(0.0))).alias("new_cluster_score")
    )


def _length(n: Column) -> Column:
    return F.greatest(F.lit(1), n)


def _length_ratio(left: Column, right: Column) -> Column:
    return F.least(_length(left), _length(right)) / F.greatest(_length(left), _length(right))


def candidate_features() -> dict[str, Column]:
    """The 16 features of a pair."""
    c = F.col
    return {
        "semantic": c("semantic"), "lexical": c("lexical"), "meta": c("meta"), "cluster": c("cluster"),
        "anchor_importance": c("a_weighty"), "importance": c("c_weighty"),
        "length_ratio": _length_ratio(c("a_n"), c("c_n")), "length": F.least(_length(c("c_n")) / 64.0, F.lit(1.0)),
        **state_features(),
    }


def padded(values: list[Column], dims: int) -> Column:
    """Values as array<double>, cut or zero-filled to `dims`."""
    return F.array(*[v.cast("double") for v in values[:dims]], *[F.lit(0.0)] * max(0, dims - len(values)))


def ablated(vector: Column, positions: list[int]) -> Column:
    """Zero the named positions."""
    return F.transform(vector, lambda v, i: F.when(i.isin(positions), 0.0).otherwise(v))


def calibration_features(budget: Column) -> dict[str, Column]:
    """48 features of a ranked candidate.

    Reads score, rank, lexical, summary_lexical, q_n, n, weighty, use_count, evidence_count, metadata (map), cluster, text, gap, sources
    (array), the usage columns, the query match flags and the derived metadata count and confidence.
    """
    c = F.col
    state = card_state()
    flag = lambda condition: condition.cast("double")
    sources = c("sources")
    has = lambda key: flag(F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")) != "")
    starts = lambda prefix: F.size(F.filter(sources, lambda s: s.startswith(prefix)))
    any_original = c("query_user_match") | c("query_project_match") | c("query_brand_match")
    derived = ["derived_user_match", "derived_project_match", "derived_brand_match"]
    any_derived = c(derived[0]) | c(derived[1]) | c(derived[2])
    confidence = clamp(c("derived_confidence"), 0.0, 1.0)
    zero = F.lit(0.0)
    return {
        "score": clamp(c("score"), -2.0, 2.0) / 2.0,
        "inverse_rank": 1.0 / F.greatest(F.lit(1), c("rank")),
        "rank": clamp(c("rank") / 256.0, 0.0, 1.0),
        "lexical": c("lexical"),
        "length_ratio": _length_ratio(c("q_n"), c("n")),
        "budget_share": F.least(_length(c("n")) / F.greatest(F.lit(1), budget), F.lit(1.0)),
        "length": F.least(_length(c("n")) / 128.0, F.lit(1.0)),
        "importance": c("weighty"),
        "use": clamp(c("use_count") / 32.0, 0.0, 1.0),
        "evidence": clamp(c("evidence_count") / 16.0, 0.0, 1.0),
        **{f"has_{k}": has(k) for k in ("session_id", "turn_id", "has_answer", "speaker", "timestamp")},
        "has_cluster": flag(c("cluster") != ""),
        "age": state["age_norm"],
        "stale": state["stale"],
        "recency": state["recency"],
        "outcome_bad": F.greatest(zero, -state["outcome"]),
        "outcome_good": F.greatest(zero, state["outcome"]),
        "conflict_terms": flag(contains_any(c("text"), CALIBRATION_CONFLICT)),
        "summary_lexical": clamp(c("summary_lexical"), 0.0, 1.0),
        "gap": clamp(c("gap"), -2.0, 2.0) / 2.0,
        "from_vector": flag(F.array_contains(sources, "vector")),
        "from_token": flag(F.array_contains(sources, "token")),
        "from_metadata": flag(starts("metadata:") > 0),
        "from_graph": flag(starts("graph:") > 0),
        "source_count": clamp(F.size(sources) / 6.0, 0.0, 1.0),
        "user_match": flag(c("query_user_match")),
        "project_match": flag(c("query_project_match")),
        "brand_match": flag(c("query_brand_match")),
        "all_match": flag(c("query_user_match") & c("query_project_match") & c("query_brand_match")),
        **{name: flag(c(name)) for name in derived},
        "derived_any": flag(any_derived),
        "derived_count": clamp(c("derived_count") / 12.0, 0.0, 1.0),
        "derived_confidence": confidence,
        "disagreement": flag(c("metadata_disagreement")),
        "only_derived": flag(~any_original & any_derived),
        "from_derived": flag(starts("derived_metadata:") > 0),
        "derived_sources": clamp(starts("derived_metadata:") / 6.0, 0.0, 1.0),
        "both_match": flag(any_original & any_derived),
        "no_metadata": flag(F.size("metadata") == 0),
        "derived_sure": flag(confidence >= 0.80),
        "derived_three": flag(c("derived_count") >= 3),
        "derived_all": flag(c(derived[0]) & c(derived[1]) & c(derived[2])),
    }


def selector_features(budget: Column) -> dict[str, Column]:
    """31 features of (query, anchor, candidate), each clamped to [-1, 1]."""
    c = F.col
    state = card_state("c_")
    overlap, conflict = preference_overlap(c("a_terms"), c("c_terms")), preference_conflict(c("a_terms"), c("c_terms"))
    mismatch = ((c("a_cluster") != "") & (c("c_cluster") != "") & (c("a_cluster") != c("c_cluster"))).cast("double")
    positive = (state["use_norm"] + state["evidence_norm"] + F.greatest(F.lit(0.0), state["outcome"]) + c("c_weighty")) / 4.0
    values = {
        "query_semantic": c("q_semantic"), "query_lexical": c("q_lexical"), "importance": c("c_weighty"),
        "budget_share": F.least(_length(c("c_n")) / F.greatest(F.lit(1), budget), F.lit(1.0)),
        "length": F.least(_length(c("c_n")) / 64.0, F.lit(1.0)),
        "query_length_ratio": _length_ratio(c("q_n"), c("c_n")),
        "has_project": (c("c_speaker") != "").cast("double"), "has_cluster": (c("c_cluster") != "").cast("double"),
        "semantic": c("semantic"), "lexical": c("lexical"), "meta": c("meta"), "cluster": c("cluster"),
        "preference_overlap": overlap, "preference_conflict": conflict, "same_context_conflict": conflict * c("cluster"),
        "anchor_importance": c("a_weighty"), "length_ratio": _length_ratio(c("a_n"), c("c_n")),
        "mismatch": mismatch, "mismatch_lexical": mismatch * c("lexical"), "mismatch_overlap": mismatch * overlap, "mismatch_conflict": mismatch * conflict,
        **{n: state[n] for n in ("age_norm", "use_norm", "evidence_norm", "outcome", "protected", "stale", "recency")},
        "mismatch_positive": mismatch * positive, "context_stale": c("cluster") * state["stale"], "context_positive": c("cluster") * positive,
    }
    return {name: clamp(value, -1.0, 1.0) for name, value in values.items()}


def frame_scalars(role: Column) -> dict[str, Column]:
    """14 scalars of a frame slot over the columns of `records.pairs`."""
    c = F.col
    state = card_state()
    values = {
        "semantic": c("semantic"), "lexical": c("lexical"), "activation": c("activation"), "importance": c("weighty"), "length": clamp(c("cost") / 90.0, 0.0, 1.0),
        **{n: state[n] for n in ("age_norm", "use_norm", "evidence_norm", "outcome", "protected", "stale", "recency")},
        "decoy_role": contains_any(role, ["decoy", "wrong"]).cast("double"), "target_role": contains_any(role, ["target", "support", "bridge"]).cast("double"),
    }
    return {name: clamp(value, -1.0, 1.0) for name, value in values.items()}


def reason_label(role: Column, relevant: Column, cluster: Column) -> Column:
    known = F.when(cluster > 0, "same_context").otherwise("cross_context_support")
    return (
        F.when(role.isin(STALE_ROLES), "stale_or_superseded")
        .when(role.isin(CROSS_ROLES), "cross_context_support")
        .when(role.isin(PREFERENCE_ROLES), "preference_memory")
        .when(relevant, known)
        .otherwise("wrong_context")
    )


def auxiliary_labels(role: Column, relevant: Column, overlap: Column, conflict: Column) -> dict[str, Column]:
    """Seven flags in the order of `AUXILIARY`."""
    same = F.col("cluster") > 0
    stale = role.isin(STALE_ROLES)
    cross = (F.col("a_cluster") != "") & (F.col("c_cluster") != "") & (F.col("a_cluster") != F.col("c_cluster"))
    flags = [
        relevant, same, role.isin(CROSS_ROLES + PREFERENCE_ROLES) | (overlap > 0), role.isin(PREFERENCE_CONFLICT_ROLES) | (same & (conflict > 0)), cross, stale,
        ~relevant & ~stale,
    ]
    return {name: flag.cast("double") for name, flag in zip(AUXILIARY, flags)}


def candidate_labels(df: DataFrame) -> DataFrame:
    """Add include_label, label_weight, include_weight and gap. `df`: q, id, score, is_relevant, is_hard (booleans)."""
    gap = F.max("score").over(Window.partitionBy("q")) - F.col("score")
    return df.select(
        "*",
        F.col("is_relevant").cast("double").alias("include_label"),
        F.when(F.col("is_relevant"), 1.0).when(F.col("is_hard"), 4.0).otherwise(1.0).alias("label_weight"),
        F.when(F.col("is_relevant"), 1.0).when(F.col("is_hard"), 8.0).otherwise(2.0).alias("include_weight"),
        gap.alias("gap"),
    )


def class_balance(labels: DataFrame, label: str, cap: float = 16.0) -> DataFrame:
    """(positive_weight): negatives / positives, at least one positive, capped."""
    positives = F.sum(F.col(label))
    return labels.agg(F.least(F.lit(cap), F.greatest(F.lit(1.0), (F.count(F.lit(1)) - positives) / F.greatest(F.lit(1.0), positives))).alias("positive_weight"))


def class_weights(labels: DataFrame, label: str, classes: list[str], cap: float = 8.0) -> DataFrame:
    """(class, weight): inverse frequency, every class starting from one, capped."""
    counts = labels.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    base = labels.sparkSession.createDataFrame([(c,) for c in classes], "class string").join(counts, "class", "left").fillna(0, ["n"])
    smoothed = base.withColumn("n", F.col("n") + 1)
    total = smoothed.agg(F.sum("n")).scalar()
    return smoothed.select("class", F.least(F.lit(cap), total / (len(classes) * F.col("n"))).alias("weight"))


def padded_frame(queries: DataFrame, ranked: DataFrame, size: int, fields: dict[str, object]) -> DataFrame:
    """One row per query: parallel arrays of the top `size` rows plus `ids` and `mask`, padded with blanks and zeros."""
    top = ranked.where(F.col("rank") <= size)
    entry = F.struct("rank", F.col("id").cast("string").alias("id"), *fields)
    listed = top.groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("slots"))
    rows = queries.select("q").join(listed, "q", "left").withColumn("slots", F.coalesce("slots", F.array().cast(listed.schema["slots"].dataType)))
    missing = F.lit(size) - F.size("slots")

    def column(name: str, blank) -> Column:
        return F.concat(F.transform("slots", lambda s: s[name]), F.array_repeat(F.lit(blank), missing)).alias(name if name != "id" else "ids")

    mask = F.concat(F.transform("slots", lambda s: F.lit(1.0)), F.array_repeat(F.lit(0.0), missing)).alias("mask")
    return rows.select("q", column("id", ""), *[column(name, blank) for name, blank in fields.items()], mask)


def frame_metrics(frames: DataFrame, k: int) -> DataFrame:
    """(q, frame_recall, frame_precision_at_k) of frames with label, mask and relevant_count."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    active = total(F.slice("mask", 1, k))
    return frames.select(
        "q",
        (total(F.col("label")) / F.greatest(F.lit(1.0), F.col("relevant_count").cast("double"))).alias("frame_recall"),
        (total(F.slice("label", 1, k)) / F.greatest(F.lit(1.0), active)).alias("frame_precision_at_k"),
    )


def learned_metrics(rows: DataFrame, relevant: DataFrame, k: int, accept: float) -> DataFrame:
    """One row: recall, precision, f1, mrr, top-1, top-3 and accuracy averaged over the queries with relevant ids."""
    hit = F.col("is_relevant") == 1
    per = rows.groupBy("q").agg(
        F.sum((hit & (F.col("rank") <= k)).cast("int")).alias("hits"),
        F.sum((F.col("rank") <= k).cast("int")).alias("top"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.avg(((F.round("score", 9) >= accept) == hit).cast("double")).alias("accuracy"),
    )
    cases = per.join(relevant, "q").select(
        ratio(F.col("hits"), F.col("relevant_count")).alias("recall"),
        ratio(F.col("hits"), F.col("top")).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce((F.col("first") <= 1).cast("double"), F.lit(0.0)).alias("top1"),
        F.coalesce((F.col("first") <= 3).cast("double"), F.lit(0.0)).alias("top3"),
        "accuracy",
    )
    cases = cases.withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-6), F.col("precision") + F.col("recall")))
    return cases.agg(F.count(F.lit(1)).alias("cases"), *[F.avg(m).alias(m) for m in ("recall", "precision", "f1", "mrr", "top1", "top3", "accuracy")])
