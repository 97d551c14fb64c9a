"""Total-order ranking, per-group top-k and budget packing.

Scores are compared at nine decimals, ties broken by id: sums arrive in any order on a cluster, and a
ranking that reads the last bits of a double would change from run to run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_PLACES = 9


def first_places(mask: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Inside a task: the k best places under the mask, best first by the rounded score, then by place."""
    places = np.flatnonzero(mask)
    value = np.round(score[places], SCORE_PLACES)
    if len(places) > k:
        cut = np.partition(value, len(value) - k)[len(value) - k]
        places, value = places[value >= cut], value[value >= cut]
    return places[np.lexsort((places, -value))[:k]]


def rounded(score: Column | str) -> Column:
    return F.round(F.col(score) if isinstance(score, str) else score, SCORE_PLACES)


def total_order(score: str = "score", tie: str | list[str] = "id") -> list[Column]:
    ties = [tie] if isinstance(tie, str) else tie
    return [rounded(score).desc(), *(F.col(t) for t in ties)]


def ranked(df: DataFrame, by: str | list[str], score: str = "score", tie: str | list[str] = "id", rank: str = "rank") -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    window = Window.partitionBy(*keys).orderBy(*total_order(score, tie))
    return df.withColumn(rank, F.row_number().over(window))


def top_k(df: DataFrame, by: str | list[str], k: int, score: str = "score", tie: str | list[str] = "id", rank: str = "rank") -> DataFrame:
    """Best k rows per group; the plan cuts each task to k per group before the shuffle (WindowGroupLimit)."""
    return ranked(df, by, score, tie, rank).where(F.col(rank) <= k)


def running(by: list[str], order: list[Column]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def pack_budget(df: DataFrame, budget: Column | int, by: str | list[str] = "q", order: str | list[str] = "rank", cost: str = "cost") -> DataFrame:
    """Ranked prefix whose running cost stays within the budget. Costs are at least 1, so the prefix stops by itself."""
    keys = [by] if isinstance(by, str) else by
    orders = [order] if isinstance(order, str) else order
    limit = F.lit(budget) if isinstance(budget, int) else budget
    window = running(keys, [F.col(o) for o in orders])
    return df.withColumn("used", F.sum(cost).over(window)).where(F.col("used") <= limit)


def pack_with_blocks(
    ranked_df: DataFrame,
    blockers: DataFrame,
    budget: int,
    max_items: int = 0,
    by: str = "q",
) -> DataFrame:
    """Pack while skipping blocker cards and every id a blocker ranked earlier names.

    `ranked_df`: q, id, rank, cost. `blockers`: q, id, blocked_id - one row per id named by a blocker card.
    Skipped rows cost nothing and fill no slot.
    """
    blocker_ids = blockers.select(by, "id").distinct().withColumn("is_blocker", F.lit(True))
    first_block = (
        ranked_df.select(by, "id", "rank")
        .join(blockers, [by, "id"])
        .groupBy(by, F.col("blocked_id").alias("id"))
        .agg(F.min("rank").alias("block_rank"))
    )
    flagged = (
        ranked_df.join(blocker_ids, [by, "id"], "left")
        .join(first_block, [by, "id"], "left")
        .withColumn("skip", F.coalesce(F.col("is_blocker"), F.lit(False)) | F.coalesce(F.col("block_rank") < F.col("rank"), F.lit(False)))
    )
    window = running([by], [F.col("rank")])
    packed = flagged.withColumn("used", F.sum(F.when(F.col("skip"), 0).otherwise(F.col("cost"))).over(window)).withColumn(
        "slot", F.sum((~F.col("skip")).cast("int")).over(window)
    )
    keep = ~F.col("skip") & (F.col("used") <= budget)
    if max_items > 0:
        keep = keep & (F.col("slot") <= max_items)
    return packed.where(keep).select(*ranked_df.columns, "used", "slot")


def pack_threshold(
    df: DataFrame,
    budget: int,
    threshold: Column | float,
    min_items: Column | int = 0,
    top_n: Column | int | None = None,
    by: str | list[str] = "q",
    probability: str = "include_probability",
) -> DataFrame:
    """Rows at or over the probability threshold first, then backfill from the head up to `min_items`, then budget and top-n."""
    keys = [by] if isinstance(by, str) else by
    chosen = (F.col(probability) >= threshold).cast("int")
    lifted = df.withColumn("chosen", chosen)
    order = [F.col("chosen").desc(), F.col("rank")]
    placed = lifted.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = placed.where((F.col("chosen") == 1) | (F.col("position") <= min_items))
    if top_n is not None:
        kept = kept.where(F.col("position") <= top_n)
    return pack_budget(kept, budget, keys, "position")
