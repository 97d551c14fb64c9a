"""Three-level basins (project > topic > route) inside a record, and the descent that searches them.

Membership stays a long table; a basin row holds only aggregates, so a basin may hold any share of the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.hashing import activation_mask, fnv1a64, umod, unit_mod
from memjoin.functions.state import AGE_SCALE, EVIDENCE_SCALE, STALE_DAYS, USE_SCALE, falsy_default
from memjoin.functions.text import clamp, contains_any, jaccard_sets, mask_coverage, token_set, tokens
from memjoin.operators.graph import expand_paths, hop_gain
from memjoin.operators.ranking import ranked, rounded, top_k
from memjoin.operators.vector import cosine_prefix
from memjoin.session import cut_lineage

# Topic terms, promotion outcome values and level multipliers.
RESOLUTION_TERMS = ["accepted resolution", "support note", "succeeded"]
ESCALATION_TERMS = ["escalation"]
CONFLICT_TERMS = ["wrong", "conflict", "superseded", "decoy"]
PROMOTION_OUTCOME = {"helpful": 0.22, "corrected": 0.07, "ignored": -0.20}
LEVEL_SHARE = {0: 0.12, 1: 0.28, 2: 0.58}
KINDS = {0: "project", 1: "topic", 2: "route"}


def project_key(project: Column, cluster: Column) -> Column:
    named = F.coalesce(F.when(project != "", project), F.when(cluster != "", cluster), F.lit("unknown"))
    return F.replace(F.lower(named), F.lit(" "), F.lit("_"))


def topic_key(text: Column) -> Column:
    first_long = F.get(F.filter(tokens(text), lambda t: F.length(t) > 3), F.lit(0))
    bucket = F.concat(F.lit("bucket_"), F.lpad(umod(fnv1a64(first_long), 16).cast("string"), 2, "0"))
    return (
        F.when(contains_any(text, RESOLUTION_TERMS), "resolution")
        .when(contains_any(text, ESCALATION_TERMS), "escalation")
        .when(contains_any(text, CONFLICT_TERMS), "conflict")
        .when(first_long.isNull(), "misc")
        .otherwise(bucket)
    )


def route_key(mask: Column) -> Column:
    return F.concat(F.lit("a"), F.lpad(mask.bitwiseAND(F.lit(31)).cast("string"), 2, "0"))


def promotion_score(bias: float = 0.0, scale: float = 1.0) -> Column:
    """How much a card deserves a place higher up; reads the standard usage columns."""
    use, evidence, age = (F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("use_count", "evidence_count", "age_days"))
    outcome = F.lit(0.0)
    for name, value in PROMOTION_OUTCOME.items():
        outcome = F.when(F.lower("last_outcome") == name, value).otherwise(outcome)
    guarded = F.coalesce("protected", F.lit(False))
    stale = (age >= STALE_DAYS) & (use <= 0) & ~guarded
    raw = (
        0.20
        + 0.30 * falsy_default(F.col("importance"), 0.5)
        + 0.18 * clamp(F.log1p(use) / math.log1p(USE_SCALE), 0.0, 1.0)
        + 0.16 * clamp(F.log1p(evidence) / math.log1p(EVIDENCE_SCALE), 0.0, 1.0)
        + 0.09 * clamp(1.0 - age / AGE_SCALE, 0.0, 1.0)
        + outcome
        + F.when(guarded, 0.12).otherwise(0.0)
        - F.when(stale, 0.18).otherwise(0.0)
        + bias
    )
    return clamp(raw * scale, 0.0, 1.0)


def promoted_at(level: int, score: Column, key: Column) -> Column:
    draw = unit_mod(fnv1a64(F.concat(key, F.lit(f":promote:{level}"))), 10_000_000)
    return draw <= rounded(clamp(score * LEVEL_SHARE[level], 0.0, 0.95))


def memory_priority(score: Column, key: Column) -> Column:
    return score + 0.06 * falsy_default(F.col("importance"), 0.5) + 0.02 * unit_mod(fnv1a64(key), 10_000_000)


def placed(cards: DataFrame) -> DataFrame:
    """Cards with project, topic, route, priority and the three promotion draws. `cards`: q, id, text, mask, vec, usage columns."""
    score = promotion_score()
    base = cards.select(
        "*",
        project_key(F.col("speaker"), F.col("cluster")).alias("project"),
        topic_key(F.col("text")).alias("topic"),
        route_key(F.col("mask")).alias("route"),
        score.alias("promotion"),
    )
    return base.select(
        "*",
        memory_priority(F.col("promotion"), F.col("id")).alias("priority"),
        *[promoted_at(level, F.col("promotion"), F.col("id")).alias(f"promote_{level}") for level in LEVEL_SHARE],
    )


def _centroid(dims: int) -> Column:
    return F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(dims)])


def _label(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind} memory basin "), key)


def basin_levels(cards: DataFrame, dims: int) -> dict[int, DataFrame]:
    """Level -> (q, key, parent, project, vec, mask, child_count). Upper levels average and OR the basins below."""
    path = {2: ["project", "topic", "route"], 1: ["project", "topic"], 0: ["project"]}
    rows = cards.groupBy("q", *path[2]).agg(_centroid(dims).alias("vec"), F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("child_count"))
    levels = {2: cut_lineage(rows)}
    for level in (1, 0):
        below = levels[level + 1]
        text = _label(KINDS[level + 1], F.concat_ws(":", *path[level + 1]))
        labelled = below.withColumn("label_mask", activation_mask(tokens(text)))
        upper = labelled.groupBy("q", *path[level]).agg(
            _centroid(dims).alias("vec"), F.bit_or("label_mask").alias("mask"), F.count(F.lit(1)).alias("child_count")
        )
        levels[level] = cut_lineage(upper)
    return {
        level: df.withColumn("key", F.concat_ws(":", *path[level])).withColumn("parent", F.concat_ws(":", *path[level][:-1])).drop("topic", "route")
        for level, df in levels.items()
    }


def basin_score(level: int) -> Column:
    text = _label(KINDS[level], F.col("key"))
    same = (F.lower("anchor_speaker") == F.lower("project")).cast("double")
    return (
        0.36 * cosine_prefix(F.col("q_vec"), F.col("vec"), 1 << 20)
        + 0.22 * jaccard_sets(F.col("q_set"), token_set(text))
        + 0.18 * mask_coverage(F.col("q_mask"), F.col("mask"))
        + 0.11 * same
        + 0.07 * 0.5
    )


def leaf_score() -> Column:
    """Score of a card over the columns of `records.pairs`."""
    return (
        0.36 * F.col("semantic")
        + 0.22 * F.col("lexical")
        + 0.18 * F.col("activation")
        + 0.11 * F.col("same_cluster")
        + 0.07 * F.col("weighty")
        + F.col("state")
        + 0.06 * F.col("weighty")
    )


def keep_basins(scored: DataFrame, floor: float, beam: int) -> DataFrame:
    """Basins at or over the floor; a query without any keeps its best `beam`."""
    placed_ = ranked(scored, "q", tie="key")
    best = F.max(rounded("score")).over(Window.partitionBy("q"))
    return placed_.withColumn("best", best).where((rounded("score") >= floor) | ((F.col("best") < floor) & (F.col("rank") <= beam)))


def descend(
    tasks: DataFrame, cards: DataFrame, pairs: DataFrame, edges: DataFrame, dims: int, floor: float = 0.32, beam: int = 4, promoted: int = 8, depth: int = 2
) -> DataFrame:
    """(q, id, score, rank, shielded): level by level to the leaves, then along edges from every card with edges.

    `pairs` has q, id and `leaf`; `shielded` marks the walked cards that later compaction must keep.
    """
    cards, pairs = cut_lineage(cards), cut_lineage(pairs.select("q", "id", "leaf"))
    levels = basin_levels(cards, dims)
    path = {0: F.col("project"), 1: F.concat_ws(":", "project", "topic"), 2: F.concat_ws(":", "project", "topic", "route")}
    offered = None
    kept = None
    for level in (0, 1, 2):
        frontier = levels[level]
        if kept is not None:
            frontier = frontier.join(kept.select("q", F.col("key").alias("parent")), ["q", "parent"], "left_semi")
        kept = keep_basins(frontier.join(tasks, "q").select("q", "key", basin_score(level).alias("score")), floor, beam)
        kept = cut_lineage(kept.select("q", "key"))
        lifted = cards.where(F.col(f"promote_{level}")).select("q", "id", path[level].alias("key"))
        lifted = lifted.join(kept.select("q", "key"), ["q", "key"], "left_semi")
        first = F.row_number().over(Window.partitionBy("q", "key").orderBy("id"))
        lifted = lifted.withColumn("n", first).where(F.col("n") <= promoted).select("q", "id", F.lit(0.03 * (3 - level)).alias("bonus"))
        offered = lifted if offered is None else offered.unionByName(lifted)
    leaves = cards.select("q", "id", path[2].alias("key")).join(kept.select("q", "key"), ["q", "key"], "left_semi")
    offered = offered.unionByName(leaves.select("q", "id", F.lit(0.0).alias("bonus")))
    leaf = pairs.select("q", "id", "leaf")
    reached = offered.groupBy("q", "id").agg(F.max("bonus").alias("bonus")).join(leaf, ["q", "id"])
    reached = reached.select("q", "id", (F.col("leaf") + F.col("bonus")).alias("score"))
    sources = edges.select("q", F.col("source").alias("id")).distinct()
    reached = cut_lineage(reached)
    seeds = ranked(reached.join(sources, ["q", "id"], "left_semi"), "q")
    walk = edges.join(leaf.withColumnRenamed("id", "target"), ["q", "target"])
    best = expand_paths(reached, seeds, walk, depth, lambda score, hop: 0.58 * score + 0.42 * F.col("leaf") + hop_gain(hop))
    shielded = seeds.select("q", "id", F.lit(True).alias("seeded"))
    out = best.join(shielded, ["q", "id"], "left").withColumn("shielded", F.coalesce("seeded", F.lit(False)) | (F.col("votes") > 0))
    return ranked(out.select("q", "id", "score", "shielded"), "q")
