"""Rescoring formulas over candidate pairs and the pool strategies that cut them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.operators.graph import expand_paths, hop_gain
from memjoin.operators.ranking import ranked, rounded, top_k


def sparse_score() -> Column:
    """Blend of similarity, cluster, metadata and usage state over the columns of `records.pairs`."""
    mismatch = F.when(F.col("same_cluster") == 0, 0.18).otherwise(0.0)
    return (
        0.27 * F.col("semantic")
        + 0.24 * F.col("activation")
        + 0.18 * F.col("lexical")
        + 0.13 * F.col("same_cluster")
        + 0.09 * F.col("metadata_match")
        + 0.09 * F.col("weighty")
        + F.col("state")
        - mismatch
    )


def sparse_ranked(pairs: DataFrame) -> DataFrame:
    return ranked(pairs.select("q", "id", sparse_score().alias("score")), "q")


def dense_ranked(pairs: DataFrame) -> DataFrame:
    return ranked(pairs.select("q", "id", F.col("semantic").alias("score")), "q")


def head_bonus(seed_count: int, each: float, rank: str = "rank") -> Column:
    """`each` x how far the row stands above the seed cut (rank is 1-based)."""
    return each * F.greatest(F.lit(0), F.lit(seed_count + 1) - F.col(rank))


def associative_base(pairs: DataFrame, seed_count: int) -> DataFrame:
    sparse = sparse_ranked(pairs).select("q", "id", (F.col("score") + head_bonus(seed_count, 0.012)).alias("score"))
    dense = dense_ranked(pairs).select("q", "id", (0.72 * F.col("score") + head_bonus(seed_count, 0.008)).alias("score"))
    return sparse.unionByName(dense).groupBy("q", "id").agg(F.max("score").alias("score"))


def associative_step(score: Column, hop: int) -> Column:
    return 0.62 * score + hop_gain(hop) + 0.07 * F.col("t_importance") + F.col("t_state")


def associative_recall(pairs: DataFrame, edges: DataFrame, seed_count: int = 8, depth: int = 3) -> DataFrame:
    base = associative_base(pairs, seed_count)
    return ranked(expand_paths(base, top_k(base, "q", seed_count), edges, depth, associative_step), "q")


def select_pool(scored: DataFrame, strategy: str) -> DataFrame:
    """Rows of a ranked list kept by `topN`, `pctP`, `zZ` or `marginM`."""
    if strategy.startswith("top"):
        return scored.where(F.col("rank") <= max(1, int(strategy[3:])))
    whole = Window.partitionBy("q")
    if strategy.startswith("pct"):
        share = float(strategy[3:]) / 100.0
        place = F.floor(share * (F.col("n") - 1))  # index from the low end
        marked = scored.withColumn("n", F.count(F.lit(1)).over(whole))
        marked = marked.withColumn("cut", F.max(F.when(F.col("n") - F.col("rank") == place, rounded("score"))).over(whole))
        return marked.where(rounded("score") >= F.col("cut")).select(*scored.columns)
    if strategy.startswith("z"):
        cut = F.avg("score").over(whole) + float(strategy[1:]) * F.stddev_pop("score").over(whole)
    elif strategy.startswith("margin"):
        cut = F.max("score").over(whole) - float(strategy[len("margin") :])
    else:
        raise ValueError(f"unknown pool strategy: {strategy}")
    return scored.withColumn("cut", cut).where(rounded("score") >= rounded("cut")).select(*scored.columns)


def calibrated_pool_recall(pairs: DataFrame, edges: DataFrame, strategy: str, seed_count: int = 8, depth: int = 3) -> DataFrame:
    """Associative recall started from a pool instead of every candidate; the walk may leave the pool."""
    sparse = sparse_ranked(pairs)
    pool = select_pool(sparse, strategy).select("q", "id").unionByName(sparse.where(F.col("rank") <= seed_count).select("q", "id")).distinct()
    held = ranked(sparse.join(pool, ["q", "id"], "left_semi").drop("rank"), "q")
    base = held.join(pairs.select("q", "id", "semantic"), ["q", "id"]).select(
        "q", "id", F.greatest(F.col("score") + head_bonus(seed_count, 0.012), 0.72 * F.col("semantic")).alias("score")
    )
    return ranked(expand_paths(base, top_k(base, "q", seed_count), edges, depth, associative_step), "q")


def frame_score() -> Column:
    """Base score of a frame candidate."""
    return (
        0.36 * F.col("semantic")
        + 0.22 * F.col("lexical")
        + 0.16 * F.col("activation")
        + 0.10 * F.col("weighty")
        + 0.09 * F.col("use_norm")
        + 0.07 * F.col("evidence_norm")
        + 0.08 * F.greatest(F.lit(0.0), F.col("outcome"))
        - 0.12 * F.col("stale")
        - F.col("role_penalty")
    )
