"""Merging, cutting and compacting ranked candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.text import contains_any
from memjoin.operators.ranking import ranked, rounded, top_k

# Terms that raise or lower a compacted card.
CONFLICT_TERMS = ["decoy", "wrong", "conflict", "superseded", "growth-noise"]
PATH_TERMS = ["accepted resolution", "support note", "succeeded", "escalation"]


def weighted_merge(sources: dict[str, tuple[DataFrame, float]], limit: int) -> DataFrame:
    """Sum of per-source scores scaled to the source's largest |score| in the query.

    Every source has q, id, score, rank and an optional `sources` array; the result has q, id, score, rank,
    source_rank (best rank in any source) and `sources`.
    """
    parts = []
    for name, (df, weight) in sources.items():
        peak = F.max(F.abs("score")).over(Window.partitionBy("q"))
        labels = F.col("sources") if "sources" in df.columns else F.array(F.lit(name))
        parts.append(
            df.withColumn("peak", peak).select(
                "q",
                "id",
                (F.lit(weight) * F.col("score") / F.when(F.col("peak") == 0, 1.0).otherwise(F.col("peak"))).alias("part"),
                F.col("rank").alias("source_rank"),
                labels.alias("labels"),
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("q", "id").agg(
        F.sum("part").alias("score"),
        F.min("source_rank").alias("source_rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("sources"),
    )
    return top_k(merged, "q", limit, tie=["source_rank", "id"])


def max_merge(vector: DataFrame, token: DataFrame, vector_weight: float = 0.70, token_weight: float = 0.30) -> DataFrame:
    """(q, id, score): larger of the weighted vector score and the weighted token score scaled to its peak."""
    peak = F.max(F.abs("score")).over(Window.partitionBy("q"))
    scaled = token.withColumn("peak", peak).select(
        "q", "id", (F.lit(token_weight) * F.col("score") / F.when(F.col("peak") == 0, 1.0).otherwise(F.col("peak"))).alias("score")
    )
    return (
        vector.select("q", "id", (F.lit(vector_weight) * F.col("score")).alias("score"))
        .unionByName(scaled)
        .groupBy("q", "id")
        .agg(F.max("score").alias("score"))
    )


def margin_cutoff(df: DataFrame, min_results: int, floor: float, margin: float) -> DataFrame:
    """Keep the first `min_results`, then rows at or over the floor and within `margin` of the query's best."""
    best = F.max("score").over(Window.partitionBy("q"))
    strong = (rounded("score") >= floor) & (rounded(F.col("best") - F.col("score")) <= margin)
    return df.withColumn("best", best).where((F.col("rank") <= min_results) | strong).drop("best")


def compact_score(score: Column, lexical: Column, activation: Column, text: Column) -> Column:
    """Compaction score of an unprotected row."""
    path = F.when(contains_any(text, PATH_TERMS), 0.20).otherwise(0.0)
    conflict = F.when(contains_any(text, CONFLICT_TERMS), 0.18).otherwise(0.0)
    return 0.42 * score + 0.24 * lexical + 0.18 * activation + path - conflict


def compact(df: DataFrame, limit: int) -> DataFrame:
    """Protected rows first by score, then the rest by `compacted`, `limit` rows per query.

    Input: q, id, score, protected_hit, compacted.
    """
    placed = df.withColumn("kept_score", F.when(F.col("protected_hit"), F.col("score")).otherwise(F.col("compacted")))
    order = [F.col("protected_hit").desc(), rounded("kept_score").desc(), F.col("id")]
    return placed.withColumn("slot", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("slot") <= limit)


def biased_rerank(df: DataFrame, memory_bias: DataFrame, signature_bias: DataFrame, scale: float) -> DataFrame:
    """score + scale * (memory bias + signature bias), ranked again. `df` carries q, id, score, signature."""
    joined = (
        df.drop("rank")
        .join(memory_bias.select("id", F.col("bias").alias("memory_bias")), "id", "left")
        .join(signature_bias.select("signature", F.col("bias").alias("signature_bias")), "signature", "left")
        .fillna(0.0, ["memory_bias", "signature_bias"])
    )
    return ranked(joined.withColumn("score", F.col("score") + scale * (F.col("memory_bias") + F.col("signature_bias"))), "q")
