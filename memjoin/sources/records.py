"""`conversations` as self-contained retrieval records: cards, one task per record, chain edges, candidate pairs.

Retrieval never leaves a record, so `q` (the record id) is a key of every join and pair rows grow linearly with the
number of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.functions.hashing import activation_mask, hash_embedding
from memjoin.functions.state import card_state, falsy_default, state_score
from memjoin.functions.text import jaccard_sets, mask_coverage, mask_overlap, token_cost, token_set, tokens
from memjoin.operators.vector import dot
from memjoin.sources import tables


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per turn; usage state is arithmetic over record and position."""
    turns = tables.turns(spark, sf_dir)
    outcomes = F.array(*[F.lit(o) for o in ("", "helpful", "corrected", "ignored")])
    return turns.select(
        F.col("uid").alias("q"),
        "pos",
        "id",
        "session",
        "speaker",
        "text",
        F.col("speaker").alias("cluster"),
        ((F.col("pos") * 37 + F.col("uid")) % 11 / 10.0).alias("importance"),
        ((F.col("pos") * 41 + F.col("uid")) % 400).alias("age_days"),
        ((F.col("uid") + F.col("pos")) % 9).alias("use_count"),
        (F.col("pos") % 5).alias("evidence_count"),
        F.element_at(outcomes, ((F.col("uid") + F.col("pos")) % 4 + 1).cast("int")).alias("last_outcome"),
        ((F.col("uid") * 7 + F.col("pos")) % 17 == 0).alias("protected"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per record: its last user turn, else its last turn. The anchor is a user card of that session."""
    chosen = F.max_by(F.struct("text", "session"), F.col("pos") + F.when(F.col("speaker") == "user", 1_000_000).otherwise(0))
    best = tables.turns(spark, sf_dir).groupBy(F.col("uid").alias("q")).agg(chosen.alias("t"))
    return best.select("q", F.col("t.text").alias("query"), F.col("t.session").alias("anchor_session"), F.lit("user").alias("anchor_speaker"))


def task_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tasks(spark, sf_dir).withColumn("toks", tokens(F.col("query")))
    return base.select(
        "q",
        "query",
        "anchor_session",
        "anchor_speaker",
        token_set(F.col("query")).alias("q_set"),
        activation_mask(F.col("toks")).alias("q_mask"),
        hash_embedding(F.col("toks")).alias("q_vec"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, id) with the pair scores every rescoring formula draws on."""
    left = task_side(spark, sf_dir)
    right = cards(spark, sf_dir).withColumn("toks", tokens(F.col("text")))
    right = right.select(
        "*", token_set(F.col("text")).alias("set"), activation_mask(F.col("toks")).alias("mask"), hash_embedding(F.col("toks")).alias("vec")
    )
    joined = right.join(left, "q")
    same_speaker = (F.col("speaker") == F.col("anchor_speaker")).cast("int")
    same_session = (F.col("session") == F.col("anchor_session")).cast("int")
    return joined.select(
        "q",
        "id",
        "pos",
        "text",
        "speaker",
        "session",
        "cluster",
        "importance",
        "age_days",
        "use_count",
        "evidence_count",
        "last_outcome",
        "protected",
        "mask",
        "q_mask",
        dot(F.col("q_vec"), F.col("vec")).alias("semantic"),
        jaccard_sets(F.col("q_set"), F.col("set")).alias("lexical"),
        mask_overlap(F.col("q_mask"), F.col("mask")).alias("activation"),
        mask_coverage(F.col("q_mask"), F.col("mask")).alias("coverage"),
        same_speaker.cast("double").alias("same_cluster"),
        ((same_speaker + same_session) / 2.0).alias("metadata_match"),
        falsy_default(F.col("importance"), 0.5).alias("weighty"),
        state_score(card_state()).alias("state"),
        token_cost(F.col("text")).alias("cost"),
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memjoin.operators.graph import chain_edges

    return chain_edges(
        cards(spark, sf_dir).select("q", "pos", "id", "session", "speaker", "text", activation_mask(tokens(F.col("text"))).alias("mask"))
    )


def scored_edges(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    """Chain edges with the query's mask overlap and the target's standing; `scored` is `pairs`."""
    from memjoin.operators.graph import type_boost

    target = scored.select("q", F.col("id").alias("target"), "q_mask", F.col("weighty").alias("t_importance"), F.col("state").alias("t_state"))
    return chain(spark, sf_dir).join(target, ["q", "target"]).select(
        "q",
        "source",
        "target",
        "epos",
        "type",
        "weight",
        "confidence",
        type_boost(F.col("type")).alias("boost"),
        mask_overlap(F.col("q_mask"), F.col("mask")).alias("overlap"),
        "t_importance",
        "t_state",
    )


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns at odd positions count as the evidence of their record."""
    return tables.turns(spark, sf_dir).where((F.col("speaker") == "assistant") & (F.col("pos") % 2 == 1)).select(F.col("uid").alias("q"), "id")
